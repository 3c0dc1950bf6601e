"""Lists, tables, constants and patterns that results depend on."""

# Tag names kept from a source feature.
TAG_NAMES = [
    "name", "name:en", "official_name", "short_name", "alt_name", "leisure", "golf", "holes",
    "golf:holes", "par", "access", "fee", "website", "wikidata", "wikipedia", "architect",
    "designer", "addr:street", "addr:housenumber", "addr:city", "addr:state", "addr:postcode",
    "addr:country", "check_date", "check_date:holes", "check_date:access",
]

# Claim properties, qualifiers and reference properties kept from a linked entity.
CLAIM_PROPERTIES = ["P31", "P17", "P131", "P361", "P527", "P625", "P856", "P571", "P576", "P84", "P2046"]
CLAIM_QUALIFIERS = ["P580", "P582", "P585"]
CLAIM_REFERENCES = ["P248", "P854", "P813"]
PERSON = "Q5"

# Access tag value -> catalog access.
ACCESS_CODES = {
    "yes": "public",
    "public": "public",
    "private": "private",
    "no": "restricted",
    "restricted": "restricted",
    "customers": "restricted",
    "permissive": "restricted",
    "permit": "restricted",
    "guests": "restricted",
    "residents": "restricted",
}

# Contact patterns.
EMAIL = r"(?iuU)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE = r"(?U)(?<!\d)(?:\+?1[ .-]?)?\(?[2-9]\d{2}\)?[ .-]\d{3}[ .-]\d{4}(?!\d)"
CONTACT_REMOVED = "[contact removed]"
ENTITY_ID = r"(?U)\bQ[1-9][0-9]*\b"

# Source URL and host patterns.
HOST_NAME = r"(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,63}"
HOST_IN_TEXT = rf"(?iU)(?<![\w.-])({HOST_NAME})(?![\w.-])"
URL_IN_TEXT = r"""(?U)https?://[^\s<>"']+"""
HOST_LABEL = r"\A[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\z"
DEFAULT_PORTS = {"http": 80, "https": 443}

# Earth radius in kilometres and the nearby limits.
EARTH_RADIUS_KM = 6371.0088
NEARBY_RADIUS_KM = 32.18688
NEARBY_MAX_RADIUS_KM = 160
NEARBY_MAX_ORIGINS = 8

# Location kinds that may be drawn on a map.
MAPPABLE_KINDS = ["property_point", "reviewed_osm_point", "verified_entrance"]

# Labels.
STYLE_LABELS = {
    "regulation": "Regulation",
    "executive": "Executive",
    "par_3": "Par3",
    "pitch_and_putt": "Pitch & Putt",
    "putting": "Grass Putting",
}
ACCESS_LABELS = {"public": "Public play", "private": "Private", "restricted": "Restricted"}
ACCESS_UNKNOWN_LABEL = "Access unconfirmed"
NO_ADDRESS_LABEL = "Address not recorded"

# Licenses.
LICENSE_FIELDS = [
    "applies_to", "attribution", "changes", "collected_on", "kind", "license", "license_url",
    "policy_capture_sha256", "policy_url", "scope", "source", "source_id", "source_url",
]
LICENSE_PRIVATE_FIELDS = ["controls_reference", "capture_path", "local_path"]
LICENSE_URLS = {
    "CC-BY-4.0": "https://creativecommons.org/licenses/by/4.0/",
    "CC-BY-SA-3.0-Unported": "https://creativecommons.org/licenses/by-sa/3.0/",
    "ODbL-1.0": "https://opendatacommons.org/licenses/odbl/1-0/",
}
CREDIT_FIELDS = [
    "attribution", "license", "source_url", "policy_url", "changes", "applies_to", "scope",
    "copyright_notice", "disclaimer_notice",
]

# Privacy scan: the kinds of space that count as a plain one.
SCAN_SPACE = (
    r"[\u0009-\u000d\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
)
URL_START = r"(^|[\x00-\x2f\x3a-\x40\x5b-\x5e\x60\x7b-\x7f“”‘’«»])"
HTTP_TOKEN = URL_START + r"""(https?://[^ <>"'`“”‘’«»]+)"""
CREDENTIAL_KEYS = [
    "access_token", "access-token", "api_key", "api-key", "apikey", "authorization",
    "client_secret", "client-secret", "credential", "password", "passwd", "secret", "token",
]
USERINFO_URL = r"https?:[/\\]*[^/\\?#]*(?:@|%40)"
PRIVATE_KEYS = [
    "access_token", "api_key", "authorization", "capture_path", "controls_reference",
    "credential", "fact_groups", "local_path", "password", "payload", "retained_document",
    "retained_evidence", "retained_pointer", "secret",
]
POSIX_PATH = r"""(?:^|[ "'`(\[={:;,<>|!?“”‘’«»])/+[^ /]"""
EXPLICIT_PATH = r"file://|[a-z\u0130\u0131\u017f\u212a]:[\\/]|\\{2}"
PATH_END = r"""[ /\\?&#;=,:'"`()<>\[\]{}|!?“”‘’«»]"""
LOCAL_ROOTS = [
    "home", "users", "root", "tmp", "var", "private", "mnt", "media", "volumes", "workspace",
    "workspaces", "task", "tasks", "srv", "opt", "etc", "usr", "proc", "sys", "dev", "run",
]
LOCAL_ROOT = (
    r"""(?:^|[ "'`(\[={:;,<>|!?“”‘’«»])/+(?:"""
    + "|".join(LOCAL_ROOTS)
    + rf")(?=$|{PATH_END}|\.+(?=$|{PATH_END}))"
)
PRIVATE_COMPONENT = (
    r"(?:[/\\?&#;=]|%2f)(?:private|secret|evidence|capture|retained|recovery)"
    rf"(?=$|[-._]|{PATH_END})"
)
PRIVATE_DECLARATION = (
    r"(?:^|[^a-z0-9_])(?:private +(?:copy|file|capture|path|directory|folder)|"
    r"local +(?:copy|file|directory|folder)|evidence +(?:copy|file|directory|folder)|"
    r"capture +(?:file|path)|capture *:|recovery +(?:sql|dump|file))(?=$|[^a-z0-9_])"
)
CORE_TEXT = [
    "access_qualification", "address_city", "address_postal_code", "address_region",
    "address_street_line1", "address_street_line2", "address_text", "arrival_reference",
    "booking_conditions", "country", "county", "description", "facility_name", "location_note",
    "name", "rated_category", "state",
]
ADDRESS_TEXT = ["text", "street_line1", "street_line2", "city", "region", "postal_code", "country"]
CHILD_ROWS = ["aliases", "components", "course_inventory", "round_options", "tee_sets"]
RELATION_TEXT_TABLES = ["component", "round_option", "tee_set", "alias"]
DOMAIN_TEXT = {
    "accessibility_observation": "qualification",
    "amenity_observation": "qualification",
    "architecture_event": "event_kind project_state qualification target_area",
    "operating_period": "aerification_method affected_area maintenance_kind period_kind qualification",
    "physical_characteristics": "elevation_unit mown_grass_name greens_grass_name landscape playing_surface qualification rough_grass_name tee_grass_name terrain",
    "policy_observation": "arrival_access_condition audience cancellation_charge_basis cancellation_charge_currency qualification season",
    "practice_observation": "driving_range_details driving_range_length_unit putting_green_details qualification range_technology_name",
    "price_observation": "amount_kind audience billing_basis conditions currency fee_kind product_name qualification residency residency_area_name season",
    "quality_rating": "dimension issuer_name qualification",
    "service_observation": "pro_shop_details qualification rental_details",
}

# Reconciliation.
DECISION_ACTIONS = ["merge_facility", "remove_component", "course", "match_course"]
MERGED_SCALARS = [
    "access", "booking_url", "contact_url", "country", "county", "name", "operating_status",
    "ownership", "physical_holes", "setting", "state", "website", "website_checked_on",
    "website_status",
]
WITHHOLDABLE_COURSE_FIELDS = [
    "website", "website_status", "website_checked_on", "address", "address_city",
    "address_country", "address_postal_code", "address_purpose", "address_region",
    "address_street_line1", "address_street_line2", "address_text", "booking_url", "contact_url",
]

# Change intake.
BATCH_ID = r"[A-Za-z0-9][A-Za-z0-9._-]{0,127}"
ENTITY_UUID = r"\A[a-z][a-z0-9_]{0,31}-[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\z"
ID_PREFIXES = {
    "facility": "f", "course": "c", "component": "p", "round_option": "r",
    "round_component": "l", "tee_set": "t", "alias": "a",
}
DOMAINS = [
    "physical_characteristics", "amenity_observation", "practice_observation",
    "service_observation", "policy_observation", "operating_period",
    "accessibility_observation", "price_observation", "architecture_event", "quality_rating",
]
DATE_FIELDS = [
    "collected_on", "observed_on", "effective_from", "effective_to", "date_from", "date_to",
    "rated_on", "source_information_as_of", "website_checked_on",
]
HOLD_LIST_KEYS = ["domains", "ordinary_aliases"]
HOLD_HOST_KEYS = ["host", "host_group", "publisher_group"]
HOLD_URL_KEYS = ["url", "source_url", "control_url", "policy_url"]
HOLD_SCOPE_KEYS = ["targets", "scope", "restricted_or_unresolved_scope"]

# CSV marker of an unknown value.
CSV_NULL = r"\N"
