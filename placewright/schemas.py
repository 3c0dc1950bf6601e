"""Table layout: keys, references, and the allowed values of every field (fixed values)."""

OPERATING = ["open", "partially_open", "temporarily_closed", "seasonally_closed", "permanently_closed", "planned", "under_renovation"]
ACCESS = ["public", "private", "restricted"]
AUDIENCE = ["adult", "junior", "senior", "student", "military", "veteran", "member", "nonmember", "resort_guest", "all_eligible"]
SEASON = ["peak", "off_peak", "winter", "summer", "spring", "autumn", "other_documented"]
LANDSCAPE = ["parkland", "links", "desert", "mountain", "coastal", "urban", "rural", "mixed"]
PURPOSE = ["clubhouse", "contact", "course", "mailing", "published_unspecified"]

# A field's kind: flag, date, text, or a tuple:
#   ("one of", values), ("whole", low, high), ("real", low, high), ("text", longest), ("code", letters)
_ADDRESS = {
    "address_text": "text",
    "address_street_line1": ("text", 512),
    "address_street_line2": ("text", 512),
    "address_city": ("text", 255),
    "address_region": ("text", 128),
    "address_postal_code": ("text", 32),
    "address_country": ("code", 2),
    "address_purpose": ("one of", PURPOSE),
}
_HOLES = ("whole", 1, None)

CORE = {
    "facility": {
        "name": ("text", None),
        "state": "text",
        "country": "text",
        "county": "text",
        **_ADDRESS,
        "physical_holes": _HOLES,
        "inventory_complete": "flag",
        "access": ("one of", ACCESS),
        "ownership": ("one of", ["municipal", "county", "state", "federal", "tribal", "private", "nonprofit", "other_documented"]),
        "setting": ("one of", LANDSCAPE),
        "operating_status": ("one of", OPERATING),
        "website": "text",
        "booking_url": "text",
        "contact_url": "text",
        "latitude": ("real", -90, 90),
        "longitude": ("real", -180, 180),
        "location_kind": ("one of", ["property_point", "reviewed_osm_point", "verified_entrance", "address_range_estimate"]),
        "website_status": ("one of", ["found", "not_checked", "unreachable", "redirected"]),
        "website_checked_on": "date",
    },
    "course": {
        "facility_id": "text",
        "name": ("text", None),
        "physical_holes": _HOLES,
        "access": ("one of", ACCESS),
        "nonmember_bookable": "flag",
        "booking_conditions": ("longest", 4000),
        "style": ("one of", ["regulation", "executive", "par_3", "pitch_and_putt", "putting"]),
        "game_kind": ("one of", ["golf", "obstacle_minigolf"]),
        "identity_status": ("one of", ["operator_defined", "needs_review", "component"]),
        "operating_status": ("one of", OPERATING),
        "website": "text",
        "booking_url": "text",
        "contact_url": "text",
        **_ADDRESS,
        "address_mode": ("one of", ["inherit", "override", "suppress"]),
        "arrival_latitude": ("real", -90, 90),
        "arrival_longitude": ("real", -180, 180),
        "arrival_kind": ("one of", ["reviewed_osm_point", "verified_entrance"]),
        "arrival_reference": "text",
        "location_note": "text",
    },
    "component": {"course_id": "text", "name": "text", "physical_holes": _HOLES},
    "round_option": {"facility_id": "text", "course_id": "text", "name": "text", "round_holes": _HOLES, "description": "text"},
    "round_component": {
        "round_id": "text", "ordinal": ("whole", 0, None), "component_id": "text", "course_id": "text", "repetitions": _HOLES,
    },
    "tee_set": {
        "course_id": "text", "round_id": "text", "name": "text", "yardage": ("above", 0),
        "yardage_unit": ("one of", ["yards", "metres"]), "par": _HOLES, "difficulty_rating": ("above", 0),
        "slope": ("whole", 55, 155), "rated_category": "text",
    },
    "alias": {"facility_id": "text", "course_id": "text", "name": "text"},
}


def _flags(names):
    return dict.fromkeys(names, "flag")


_MINUTE = ("whole", 0, 1439)
_MASK = ("whole", 1, 127)
_AGE = ("whole", 0, 120)
_GROUP = ("whole", 1, 1000000)
_MONEY = ("real", 0, 1e12)
_COUNT = ("whole", 0, 100000)
_LONG_RATING = ("real", -1e9, 1e9)

DOMAINS = {
    "source_observation": {
        "collected_on": "date", "observed_on": "date", "effective_from": "date", "effective_to": "date",
        "status": ("one of", ["retained", "extracted", "confirmed"]),
        "origin": ("one of", ["retained_input", "retained_normalization", "new_extraction"]),
        "conflict": "flag", "qualification": ("text", 4000), "retained_pointer": ("text", 2000),
    },
    "physical_characteristics": {
        "acreage": ("real", 1e-06, 1e12), **_flags([
            "acreage_approximate", "water_features", "wooded",
        ]),
        "landscape": ("one of", LANDSCAPE), "terrain": ("one of", ["flat", "rolling", "hilly", "mixed"]),
        "playing_surface": ("one of", ["natural_grass", "synthetic", "mixed"]),
        "greens_grass_name": ("text", 512), "mown_grass_name": ("text", 512), "tee_grass_name": ("text", 512), "rough_grass_name": ("text", 512),
        "elevation": ("real", -500, 10000), "elevation_unit": ("one of", ["metres", "feet"]),
    },
    "amenity_observation": {
        "clubhouse_available": "flag", "restaurant_available": "flag", "bar_available": "flag", "snack_bar_available": "flag",
        "lodging_available": "flag", "casino_available": "flag", "spa_available": "flag", "pool_available": "flag",
        "locker_rooms_available": "flag", "showers_available": "flag", "restrooms_available": "flag",
        "drinking_water_available": "flag", "tennis_available": "flag", "pickleball_available": "flag",
        "banquet_space_available": "flag", "parking_available": "flag",
    },
    "practice_observation": {
        **_flags([
            "driving_range_available", "driving_range_lighted", "driving_range_covered", "driving_range_heated",
            "driving_range_double_sided", "range_grass_tees_available", "range_mat_tees_available",
            "putting_green_available", "chipping_area_available", "short_game_area_available",
            "practice_bunker_available", "indoor_simulator_available",
        ]),
        "driving_range_station_count": _COUNT, "driving_range_tier_count": ("whole", 1, 20),
        "driving_range_length": _MONEY, "driving_range_length_unit": ("one of", ["yards", "metres"]),
        "putting_green_count": _COUNT, "practice_bunker_count": _COUNT, "indoor_simulator_count": _COUNT,
        "range_technology_name": ("text", 512), "driving_range_details": ("text", 2000), "putting_green_details": ("text", 2000),
    },
    "service_observation": {
        **_flags([
            "pro_shop_available", "pro_shop_full_service", "pro_shop_stocked", "club_rental_available",
            "push_cart_rental_available", "golf_cart_rental_available", "caddie_available", "forecaddie_available",
            "instruction_available", "club_fitting_available", "club_repair_available", "golf_academy_available",
            "golf_learning_center_available", "club_sales_available", "club_trade_ins_accepted",
            "memberships_available", "event_booking_available",
        ]),
        "pro_shop_details": ("text", 2000), "rental_details": ("text", 2000),
    },
    "policy_observation": {
        **_flags([
            "ordinary_nonmember_allowed", "member_sponsor_required", "club_affiliation_required",
            "resort_stay_required", "walk_in_play_allowed", "tee_time_reservations_accepted", "walking_allowed",
            "carts_required", "caddie_required", "outside_food_allowed", "denim_allowed", "collared_shirt_required",
            "applies_on_holidays", "ends_next_day",
        ]),
        "booking_window_days": ("whole", 0, 3650), "booking_opens_minute_of_day": _MINUTE,
        "minimum_cancellation_notice_hours": ("real", 0, 8760), "minimum_player_age": _AGE, "minimum_cart_driver_age": _AGE,
        "arrival_access_condition": ("one of", ["none", "photo_id", "visitor_pass", "military_id", "resort_check_in", "member_sponsor", "other_documented"]),
        "cancellation_charge_basis": ("one of", ["fixed_amount", "percent_of_booking", "full_booking"]),
        "cancellation_charge_amount": _MONEY, "cancellation_charge_currency": ("code", 3), "cancellation_charge_percent": ("real", 0, 100),
        "weekday_mask": _MASK, "start_minute_of_day": _MINUTE, "end_minute_of_day": _MINUTE,
        "season": ("one of", SEASON), "audience": ("one of", AUDIENCE), "minimum_group_size": _GROUP, "maximum_group_size": _GROUP,
    },
    "operating_period": {
        "period_kind": ("one of", ["regular_hours", "season", "maintenance", "closure", "planned_reopening"]),
        **_flags([
            "is_open", "closes_next_day", "year_round",
        ]), "date_from": "date", "date_to": "date",
        "annual_start_month": ("whole", 1, 12), "annual_start_day": ("whole", 1, 31),
        "annual_end_month": ("whole", 1, 12), "annual_end_day": ("whole", 1, 31), "weekday_mask": _MASK,
        "opens_minute_of_day": _MINUTE, "closes_minute_of_day": _MINUTE,
        "maintenance_kind": ("one of", ["aerification", "topdressing", "overseeding", "mowing", "turf_treatment", "reconstruction", "other_documented"]),
        "aerification_method": ("one of", ["hollow_tine", "solid_tine", "deep_tine", "liquid", "other_documented"]),
        "affected_hole_count": ("whole", 1, 1000),
        "affected_area": ("one of", ["whole_facility", "whole_course", "selected_holes", "greens", "driving_range", "clubhouse", "other_documented"]),
    },
    "accessibility_observation": {
        **_flags([
            "wheelchair_accessible_clubhouse", "accessible_parking_available", "accessible_restroom_available",
            "adaptive_cart_available", "accessible_cart_available", "accessible_practice_area_available",
            "step_free_clubhouse_access",
        ]),
        "advance_notice_required_hours": ("real", 0, 8760), "advance_notice_recommended_hours": ("real", 0, 8760),
    },
    "price_observation": {
        "fee_kind": ("one of", ["green_fee", "golf_cart", "push_cart", "club_rental", "nonplayer_rider", "range_balls", "practice_pass", "instruction", "booking_fee", "membership", "event", "other_documented"]),
        "amount_min": _MONEY, "amount_max": _MONEY, "amount_kind": ("one of", ["exact", "range", "starting_at", "discount"]),
        "currency": ("code", 3),
        "billing_basis": ("one of", ["per_person", "per_cart", "per_round", "per_bucket", "per_ball", "per_hour", "per_day", "per_month", "per_year", "per_event"]),
        "round_holes": ("whole", 1, 1000), "quantity": _GROUP, "audience": ("one of", AUDIENCE),
        "residency": ("one of", ["resident", "nonresident", "all_eligible"]), "residency_area_name": ("text", 512),
        "minimum_age": _AGE, "maximum_age": _AGE, "weekday_mask": _MASK, "start_minute_of_day": _MINUTE, "end_minute_of_day": _MINUTE,
        **_flags([
            "applies_on_holidays", "ends_next_day", "cart_included", "tax_included", "practice_included",
            "resort_stay_required", "member_sponsor_required", "club_affiliation_required", "historical",
            "dynamic_pricing", "unconditional", "prepayment_required", "second_round_required",
            "same_day_second_round_required",
        ]),
        "season": ("one of", SEASON), "discount_percent": ("real", 0, 100), "source_information_as_of": "date",
        "minimum_group_size": _GROUP, "maximum_group_size": _GROUP,
        "minimum_advance_purchase_days": ("real", 0, 3650), "maximum_advance_purchase_days": ("real", 0, 3650),
        "product_name": ("text", 512), "conditions": ("text", 4000),
    },
    "design_party": {"name": ("text", 255), "party_kind": ("one of", ["person", "firm"])},
    "architecture_event": {
        "event_kind": ("one of", ["design", "opening", "redesign", "renovation", "restoration", "expansion", "founding", "construction"]),
        "project_state": ("one of", ["planned", "in_progress", "completed", "cancelled"]),
        "target_area": ("one of", ["whole_facility", "whole_course", "nine_hole_component", "greens", "tees", "mown_areas", "clubhouse", "practice_area"]),
        "event_year": ("whole", 1, 9999), "event_month": ("whole", 1, 12), "event_day": ("whole", 1, 31), "year_end": ("whole", 1, 9999),
        "physical_holes_before": ("whole", 1, 1000), "physical_holes_after": ("whole", 1, 1000),
    },
    "architecture_credit": {"role": ("one of", ["original_design", "redesign", "renovation", "restoration", "expansion"])},
    "quality_rating": {
        "issuer_name": ("text", 512), "score": _LONG_RATING, "scale_min": _LONG_RATING, "scale_max": _LONG_RATING,
        "rated_on": "date", "dimension": ("one of", ["overall", "conditioning", "design", "value", "service", "practice"]),
    },
}

# The exact subjects each domain may have: exactly one of them is known.
SUBJECTS = {
    "alias": ["facility_id", "course_id"],
    "round_option": ["facility_id", "course_id"],
    "round_component": ["component_id", "course_id"],
    "tee_set": ["course_id", "round_id"],
    "fact_group": ["facility_id", "course_id"],
    "physical_characteristics": ["facility_id", "course_id", "component_id"],
    "architecture_event": ["facility_id", "course_id", "component_id"],
    "policy_observation": ["facility_id", "course_id", "round_id"],
    "price_observation": ["facility_id", "course_id", "round_id"],
} | dict.fromkeys(
    ["amenity_observation", "practice_observation", "service_observation", "operating_period", "accessibility_observation", "quality_rating"],
    ["facility_id", "course_id"],
)

REQUIRED = {
    "facility": ["name", "country"],
    "course": ["identity_status", "address_mode"],
    "component": ["course_id", "name"],
    "round_option": ["name", "round_holes"],
    "round_component": ["round_id", "ordinal", "repetitions"],
    "tee_set": ["name"],
    "alias": ["name"],
    "source_observation": ["status", "origin", "conflict"],
    "design_party": ["name"],
    "architecture_credit": ["event_id", "party_id"],
    "quality_rating": ["issuer_name"],
}

# Rules over several fields of one row.
ROW_RULES = {
    "facility": {
        "latitude and longitude together": "(latitude is null) = (longitude is null)",
        "location kind with location": "latitude is null or location_kind is not null",
    },
    "course": {
        "arrival latitude and longitude together": "(arrival_latitude is null) = (arrival_longitude is null)",
        "arrival kind and reference with arrival": "arrival_latitude is null or (arrival_kind is not null and arrival_reference is not null and arrival_reference rlike '(?U)\\\\S')",
        "own address only where overridden": "address_mode = 'override' or coalesce({address}) is null",
    },
    "tee_set": {"unit with yardage": "yardage is null or yardage_unit is not null"},
    "source_observation": {
        "new extraction names source and date": "origin <> 'new_extraction' or (source_id is not null and collected_on is not null)",
        "retained evidence is named": "origin not in ('retained_input', 'retained_normalization') or retained_group_id is not null or retained_facility_id is not null",
        "effective dates in order": "effective_from <= effective_to",
    },
    "physical_characteristics": {"unit with elevation": "elevation is null or elevation_unit is not null"},
    "practice_observation": {"unit with range length": "driving_range_length is null or driving_range_length_unit is not null"},
    "policy_observation": {
        "group sizes in order": "minimum_group_size <= maximum_group_size",
        "time window": "{window:start_minute_of_day,end_minute_of_day,ends_next_day}",
        "fixed charge has amount basis and currency": "cancellation_charge_amount is null or (cancellation_charge_basis <=> 'fixed_amount' and cancellation_charge_currency is not null)",
        "currency only for a fixed charge": "cancellation_charge_currency is null or cancellation_charge_basis <=> 'fixed_amount'",
        "percent only for a percent charge": "cancellation_charge_percent is null or cancellation_charge_basis <=> 'percent_of_booking'",
        "full charge has no amount": "not (cancellation_charge_basis <=> 'full_booking') or coalesce(cancellation_charge_amount, cancellation_charge_percent) is null and cancellation_charge_currency is null",
    },
    "operating_period": {
        "dates in order": "date_from <= date_to",
        "start day has a month": "annual_start_day is null or annual_start_month is not null",
        "end day has a month": "annual_end_day is null or annual_end_month is not null",
        "start day is in the month": "annual_start_day is null or annual_start_month is null or try_to_date(format_string('2000-%02d-%02d', annual_start_month, annual_start_day), 'yyyy-MM-dd') is not null",
        "end day is in the month": "annual_end_day is null or annual_end_month is null or try_to_date(format_string('2000-%02d-%02d', annual_end_month, annual_end_day), 'yyyy-MM-dd') is not null",
        "opening window": "{window:opens_minute_of_day,closes_minute_of_day,closes_next_day}",
    },
    "price_observation": {
        "amounts in order": "amount_min <= amount_max",
        "exact price is one amount": "amount_kind <> 'exact' or (amount_min is not null and amount_max is not null and amount_min = amount_max)",
        "ages in order": "minimum_age <= maximum_age",
        "time window": "{window:start_minute_of_day,end_minute_of_day,ends_next_day}",
        "group sizes in order": "minimum_group_size <= maximum_group_size",
        "advance purchase in order": "minimum_advance_purchase_days <= maximum_advance_purchase_days",
        "same-day round is a second round": "not (same_day_second_round_required <=> true) or second_round_required <=> true",
    },
    "architecture_event": {
        "month has a year": "event_month is null or event_year is not null",
        "day has a month": "event_day is null or event_month is not null",
        "years in order": "event_year <= year_end",
        "day is in the month": "event_day is null or event_month is null or event_year is null or try_to_date(format_string('%04d-%02d-%02d', event_year, event_month, event_day), 'yyyy-MM-dd') is not null",
    },
    "quality_rating": {
        "score lies on its scale": "score is null or (scale_min is not null and scale_max is not null and scale_min < scale_max and score between scale_min and scale_max)",
    },
}

# Child column -> parent table, for every reference in the layout.
REFERENCES = {
    "alias": {"facility_id": "facility", "course_id": "course"},
    "component": {"course_id": "course"},
    "course": {"facility_id": "facility"},
    "round_option": {"facility_id": "facility", "course_id": "course"},
    "round_component": {"round_id": "round_option", "component_id": "component", "course_id": "course"},
    "tee_set": {"course_id": "course", "round_id": "round_option"},
    "source_observation": {"source_id": "source", "retained_facility_id": "facility", "retained_group_id": "fact_group"},
    "fact_group": {"facility_id": "facility", "course_id": "course"},
    "architecture_credit": {"event_id": "architecture_event", "party_id": "design_party"},
}

# The typed domains: each row has one observation and one of the domain's subjects.
TYPED = [
    "physical_characteristics", "amenity_observation", "practice_observation", "service_observation", "policy_observation",
    "operating_period", "accessibility_observation", "price_observation", "architecture_event", "quality_rating",
]
SUBJECT_PARENTS = {"facility_id": "facility", "course_id": "course", "component_id": "component", "round_id": "round_option"}
for _domain in TYPED:
    REFERENCES[_domain] = {"observation_id": "source_observation", **{s: SUBJECT_PARENTS[s] for s in SUBJECTS[_domain]}}
REFERENCES["price_observation"]["qualifying_prior_round_id"] = "round_option"

KEYS = {
    "facility": "facility_id", "course": "course_id", "component": "component_id", "round_option": "round_id",
    "round_component": "member_id", "tee_set": "tee_id", "alias": "alias_id", "source": "source_id",
    "source_observation": "observation_id", "fact_group": "group_id", "physical_characteristics": "physical_id",
    "amenity_observation": "amenity_id", "practice_observation": "practice_id", "service_observation": "service_id",
    "policy_observation": "policy_id", "operating_period": "period_id", "accessibility_observation": "accessibility_id",
    "price_observation": "price_id", "design_party": "party_id", "architecture_event": "event_id",
    "architecture_credit": "credit_id", "quality_rating": "rating_id",
}

# Composite keys: columns, and the condition under which they must be unique.
UNIQUE = {
    "round_component": [(["round_id", "ordinal"], None)],
    "architecture_credit": [(["event_id", "party_id", "role"], None), (["event_id", "party_id"], "role is null")],
}

# Columns whose values are catalog ids; rekeying touches these and nothing else.
REFERENCE_COLUMNS = ["facility_id", "course_id", "destination_id", "entity_id", "course_ids", "documented_course_ids"]

ADDRESS_COLUMNS = list(_ADDRESS)
