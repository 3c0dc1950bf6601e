"""Main text of web pages: a suffix array per host finds what its pages share; structure checks it.

All token streams of a host's pages on end form the host's text, whose suffix array shows the long
runs of tokens that stand on distinct pages. What they cover is boilerplate and goes; unique runs
stay. Structure says what is judged: on a page with an article (or main) element, the blocks in it,
less the menus, headers, notices and so on inside it, and a block goes only whole, if different
articles of the host have it, never the first one (the title), and only if most of the article
stays, so that an article printed twice keeps its paragraphs. On other pages, and where the blocks outside outweigh the article
elements (teasers), every block outside such parts is judged token by token.

Large hosts are cut into slices of bounded size. The suffix array of a slice tells its different
leading runs of RUN tokens, each once; slices meet over these runs, so neither a hot host nor a
footer on all its pages is one group. Most runs stand on one page only and need not travel: a run is
named by the smallest hash of its pieces of GRAM tokens, slices send those names as sorted, packed
numbers to the name's bucket, and only runs whose name is known to two slices, or that a slice has
found on two of its own pages, are exchanged and compared in full. Runs of which no page is judged
(menus and footers that no article holds) are left out there too.
"""

import html as entities
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import functions as F

from .common import columns, new_folder, settle

RUN = 8  # tokens of the shortest run that counts
SHORT = 4  # words of the shortest block in an article that goes as a whole
GRAM = 4  # tokens of the pieces whose smallest hash names a run
SLICE_TOKENS = 2_000_000
CHUNK_TOKENS = 500_000  # tokens whose runs are named at once
BUCKET_TOKENS = 1 << 25  # tokens of the corpus for each bucket of names

# Element names of the HTML standard, and words that sites use for parts of a page.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table "
    "tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style title textarea template noscript iframe object svg math canvas audio video map head".split())
RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
FRAMES = frozenset("nav header footer aside form menu dialog button select fieldset datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
PARTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disclaimer discussion dropdown footer gdpr hidden login masthead menu modal nav navbar navigation newsletter "
    "notice notification overlay pager pagination popup promo promotion related respond sharing share sidebar signup skip "
    "social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
HEADS = frozenset("header siteheader pageheader topbar site-header page-header main-header".split())
TITLES = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())

# Words that only say where a part is or what holds it: `site-nav` and `share-buttons` are parts, `market-share` isn't.
PLAIN = frozenset(
    "site main page top bottom left right primary secondary global mobile desktop sticky fixed list bar box block wrap wrapper "
    "container area inner outer slot unit zone module link links button buttons item items icon icons section group row holder panel form".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|<[!?/][^>]*+>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s\"'=<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
_INSIDE, _OPEN, _FRAME = 2, 1, 0


def host_of(url):
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def _role(name, attributes, inside):
    """`drop` (no text at all), `frame` (a part around the text), `byline`, `main` or nothing, of an element."""
    if name in UNSEEN:
        return "drop"
    values = {}
    if attributes:
        for key, *value in _ATTRIBUTE.findall(attributes):
            values.setdefault(key.lower(), entities.unescape("".join(value)).lower())
    words = f"{values.get('class', '')} {values.get('id', '')}".split()
    if name == "header" and inside and HEADS.isdisjoint(words):
        return "byline"
    if name in FRAMES or values.get("role") in ROLES:
        return "frame"
    if "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", ""):
        return "drop"
    for word in words:
        parts = re.split(r"[-_]+", word)
        named = not PARTS.isdisjoint(parts) and all(p in PARTS or p in PLAIN for p in parts)
        if word in HEADS or (name not in ("html", "body", "article", "main") and named):
            return "frame"
        if name in ("article",) and word.startswith("comment"):
            return "frame"
    if name in ("article", "main") or values.get("role") in ("main", "article"):
        return "main"
    return ""


def blocks(source):
    """(text, kind) of each block with text, in page order; kind: inside a main element, open, or frame.

    If all article and main elements stand in frames, what holds the first of them (a form round the
    page, a menu that is never closed) is no frame.
    """
    found, holders = _blocks(source, frozenset())
    if holders and not any(kind == _INSIDE for _, kind in found):
        found, _ = _blocks(source, holders)
    return found


def _blocks(source, holders):
    """The blocks, where the elements that begin at `holders` are no frames; and the beginnings of the
    frames that hold the first article or main element."""
    out, words, stack, at = [], [], [], 0
    held = None
    state = {"drop": 0, "frame": 0, "main": 0, "byline": 0, "title": 0}

    def flush():
        text = " ".join("".join(words).split())
        words.clear()
        if text:
            kind = _FRAME if state["frame"] or (state["byline"] and not state["title"]) else _INSIDE if state["main"] else _OPEN
            out.append((text, kind))

    def close(upto):
        while len(stack) > upto:
            for role in stack.pop()[1]:
                state[role] -= 1

    def say(text):
        if text and not state["drop"]:
            words.append(entities.unescape(text) if "&" in text else text)

    for found in _TOKEN.finditer(source):
        if found.start() < at:
            continue
        say(source[at : found.start()])
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        closing, attributes = found[1] or found[4], found[3] or found[6] or ""
        if name in BLOCKS:
            flush()
        elif name == "br":
            say(" ")
        if closing:
            spot = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if spot is not None:
                close(spot)
            continue
        if name in VOID:
            continue
        if name in BLOCKS and stack:
            # A block ends an open paragraph; a list item, row or cell its open sibling's paragraph too.
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in BLOCKS:
                    break
        if attributes.rstrip().endswith("/") and name in ("svg", "math", "path"):
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(source, at)
            at = end.start() if end else len(source)
            stack.append((name, ("drop",), found.start()))
            state["drop"] += 1
            continue
        role = _role(name, attributes, state["main"])
        if role == "frame" and found.start() in holders:
            role = ""
        if role == "main" and held is None:
            held = frozenset(start for _, roles, start in stack if "frame" in roles)
        roles = (*((role,) if role else ()), *(("title",) if name in TITLES else ()))
        if role == "main" and state["frame"]:
            roles = ()  # a teaser or a comment inside a frame
        stack.append((name, roles, found.start()))
        for r in roles:
            state[r] += 1
    say(source[at:])
    flush()
    return out, held or frozenset()


def _hash(texts):
    """Word hashes of an array of texts, on end; each different word is hashed once."""
    words = pc.split_pattern(texts, " ").flatten().dictionary_encode()
    known = words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
    return np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))[words.indices.to_numpy()]


_PAD = np.uint64(0x9E3779B97F4A7C15)  # stands after a short block, which is a run of its own


def judged(found):
    """(blocks to judge, other blocks, whether they are an article's) of a page's blocks."""
    inside, open_ = ([t for t, k in found if k == kind] for kind in (_INSIDE, _OPEN))
    words = [sum(t.count(" ") + 1 for t in part) for part in (inside, open_)]
    if inside and words[0] >= words[1]:
        return inside, [t for t, k in found if k != _INSIDE], True
    return [t for t, k in found if k != _FRAME], [t for t, k in found if k == _FRAME], False


def streams_of(parts, others, sizes, rest, article, run=RUN):
    """Token hashes of each page of some columns: the judged blocks, then the others, then an article's short
    blocks again, each filled up to a run."""
    own, more = _hash(parts.flatten()), _hash(others.flatten())
    sizes_ = sizes.flatten().to_numpy()
    place = np.append(0, np.cumsum(sizes_)).tolist()
    first = np.append(0, np.cumsum(pc.list_value_length(sizes).to_numpy())).tolist()
    past = np.append(0, np.cumsum(rest.to_numpy())).tolist()
    sizes_ = sizes_.tolist()
    for k, whole in enumerate(article.to_pylist()):
        a, b = first[k], first[k + 1]
        short = []
        for at, n in zip(place[a:b], sizes_[a:b], strict=True) if whole else ():
            if SHORT <= n < run:
                short += [own[at : at + n], np.full(run - n, _PAD)]
        yield np.concatenate([own[place[a] : place[b]], more[past[k] : past[k + 1]], *short])


def mark_of(parts, others, article):
    """By which pages are told apart: copies of a page, and pages of one article (its longest block),
    count as one, so that they aren't each other's boilerplate."""
    identity = max(parts, key=len) if article else " ".join((*parts, *others))
    return xxhash.xxh64_intdigest(identity.encode("utf-8", "surrogatepass")) - (1 << 63)


def lost(sizes, covered, rest, article, run=RUN):
    """What goes, by the words of each judged block, the first tokens of covered runs and the words of the
    other blocks: numbers of whole blocks on a page with an article, else of words."""
    gone = np.zeros(max(covered, default=0) + run, bool)
    for at in covered:
        gone[at : at + run] = True
    total = sum(sizes)
    if not article:
        return np.flatnonzero(gone[:total]).tolist()
    at, begun, extra = 0, set(covered), total + rest
    whole = []
    for n in sizes:
        # A run within the block's own words, or a short block's own run.
        whole.append(n >= SHORT and at + n <= len(gone) and bool(gone[at : at + n].all()))
        if SHORT <= n < run:
            whole[-1] |= extra in begun
            extra += run
        at += n
    whole[0] = False  # the title, even if others have it
    if 2 * sum(n for n, w in zip(sizes, whole, strict=True) if w) > total:
        return []  # most of it stands elsewhere too: the article itself is printed again
    return [k for k, w in enumerate(whole) if w]


def without(parts, gone, article):
    """The judged blocks less what goes."""
    gone = set(gone or ())
    if article or not gone:
        return [t for k, t in enumerate(parts) if k not in gone]
    kept, at = [], 0
    for t in parts:
        words = t.split(" ")
        left = [w for k, w in enumerate(words, at) if k not in gone]
        at += len(words)
        if left:
            kept.append(" ".join(left))
    return kept


def _parse(pages):
    """Per page its slice, number, host, mark, judged and other blocks, words of each judged block and of all
    others, and whether they are an article's. A slice is some SLICE_TOKENS of one task's pages."""
    kind = (
        f"slice long, row long, page_id {pages.schema['page_id'].dataType.simpleString()}, url string, host long, mark long, "
        "parts array<string>, others array<string>, sizes array<int>, rest int, article boolean"
    )
    types = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.int32(), pa.bool_()]
    names = ["slice", "row", "page_id", "url", "host", "mark", "parts", "others", "sizes", "rest", "article"]

    def parse(batches):
        task, number, size = TaskContext.get().partitionId() << 33, 0, 0
        for batch in batches:
            out, slices = [], []
            for url, source in zip(batch[1].to_pylist(), batch[2], strict=True):
                parts, others, article = judged(blocks(source.as_py() or ""))
                host = xxhash.xxh64_intdigest(host_of(url).encode("utf-8", "surrogatepass")) - (1 << 63)
                sizes, rest = [t.count(" ") + 1 for t in parts], sum(t.count(" ") + 1 for t in others)
                slices.append(task + size // SLICE_TOKENS)
                size += sum(sizes) + rest
                out.append((host, mark_of(parts, others, article), parts, others, sizes, rest, article))
            found = list(zip(*out, strict=True)) if out else [()] * len(types)
            rows = pa.array(np.arange(task + number, task + number + batch.num_rows))
            number += batch.num_rows
            yield pa.record_batch([pa.array(slices, pa.int64()), rows, batch[0], batch[1], *[pa.array(v, t) for v, t in zip(found, types, strict=True)]], names=names)

    return pages.mapInArrow(parse, kind)


_STREAMED = ["slice", "row", "host", "mark", "parts", "others", "sizes", "rest", "article"]


def _chunks(batches, most, run):
    """Streams of some pages of a slice on end, up to `most` tokens or one page: slice, row, host, mark, judged
    words and first word past the others of each page, tokens, and the page of each token. The host is
    part of every token, so that pages of two hosts never share a run."""
    pages, size, last = [], 0, None

    def close():
        rows, hosts, marks, judged_, past, streams = zip(*pages, strict=True)
        page = np.repeat(np.arange(len(pages)), [len(s) for s in streams])
        hosts = np.array(hosts, np.int64)
        tokens = np.concatenate(streams) ^ (hosts[page].view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        return last, np.array(rows), hosts, np.array(marks, np.int64), np.array(judged_), np.array(past), tokens, page

    for batch in batches:
        judged_ = [sum(sizes) for sizes in batch["sizes"].to_pylist()]
        kept = [batch[name].to_pylist() for name in ("slice", "row", "host", "mark", "rest")]
        streams = streams_of(*[batch[name] for name in ("parts", "others", "sizes", "rest", "article")], run)
        for slice_, row, host, mark, rest, words, stream in zip(*kept, judged_, streams, strict=True):
            if slice_ != last and pages:
                yield close()
                pages, size = [], 0
            last = slice_
            if len(stream) < run:
                continue
            pages.append((row, host, mark, words, words + rest, stream))
            size += len(stream)
            if size >= most:
                yield close()
                pages, size = [], 0
    if pages:
        yield close()


def suffix_groups(tokens, page, run=RUN):
    """Groups of the suffixes of a slice by their first `run` tokens, by prefix doubling.

    Returns positions in suffix order and where each group of a common leading run starts. Only
    suffixes with `run` tokens left on their own page count.
    """
    n = len(tokens)
    _, rank = np.unique(tokens, return_inverse=True)
    rank, done = rank.reshape(-1).astype(np.int64) + 1, 1
    while done < run:
        step = min(done, run - done)
        other = np.zeros(n, np.int64)
        other[: n - step] = rank[step:]
        same = np.zeros(n, bool)
        same[: n - step] = page[step:] == page[: n - step]
        pair = rank * (n + 2) + np.where(same, other, 0)
        _, rank = np.unique(pair, return_inverse=True)
        rank, done = rank.reshape(-1).astype(np.int64) + 1, done + step
    whole = np.zeros(n, bool)
    whole[: max(0, n - run + 1)] = page[run - 1 :] == page[: max(0, n - run + 1)]
    at = np.flatnonzero(whole)
    order = at[np.argsort(rank[at], kind="stable")]
    first = np.flatnonzero(np.append(True, rank[order][1:] != rank[order][:-1])) if len(order) else order
    return order, first


def _leading(tokens, run, spread=False):
    """A number for each run of tokens, by its first place."""
    h = np.full(max(0, len(tokens) - run + 1), np.uint64(run))
    for k in range(run):
        h = h * np.uint64(0x9E3779B97F4A7C15) + tokens[k : k + len(h)]
    h ^= h >> np.uint64(31)
    if spread:
        h = h * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def _names(tokens, run, bits):
    """The name of each run, by its first place: the smallest hash of its pieces, cut to some bits."""
    gram = min(GRAM, run)
    pieces = _leading(tokens, gram, spread=True) >> np.uint64(64 - bits)
    n = max(0, len(tokens) - run + 1)
    return np.minimum.reduce([pieces[k : k + n] for k in range(run - gram + 1)]).view(np.int64)


def _pack(numbers):
    """Sorted different numbers as their differences, byte by byte, compressed."""
    steps = np.diff(numbers, prepend=0).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack(packed):
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").reshape(-1)).astype(np.int64)


_EVIDENCE, _JUDGED, _FOUND = 0, 1, 2


def _slice_names(parsed, run, bits, shift):
    """bucket, slice, kind, packed: names of a slice's different runs; of runs outside judged blocks, of runs in
    them, and of runs in them that pages of two marks in the slice share."""

    def tell(batches):
        for slice_, _, host, mark, judged_, past, tokens, page in _chunks(batches, SLICE_TOKENS, run):
            # A host's streams stand on end.
            order = np.argsort(host[page], kind="stable")
            start = np.arange(len(page)) - np.searchsorted(page, page)
            aim = (start < judged_[page]) | (start >= past[page])
            names = np.append(_names(tokens, run, bits), np.zeros(run - 1, np.int64))
            suffixes, first = suffix_groups(tokens[order], page[order], run)
            if not len(first):
                continue
            suffixes = order[suffixes]
            seen = mark[page[suffixes]]
            aimed = np.logical_or.reduceat(aim[suffixes], first)
            twice = np.minimum.reduceat(seen, first) != np.maximum.reduceat(seen, first)
            kinds = np.where(aimed & twice, _FOUND, np.where(aimed, _JUDGED, _EVIDENCE))
            pairs = np.unique(names[suffixes[first]] * 4 + kinds)  # by name, the strongest kind last
            last = np.append(pairs[1:] >> 2 != pairs[:-1] >> 2, True)
            name, kinds = pairs[last] >> 2, pairs[last] & 3
            out = []
            for kind in (_EVIDENCE, _JUDGED, _FOUND):
                own = name[kinds == kind]
                bucket = own >> shift
                ends = [*np.flatnonzero(np.diff(bucket)) + 1, len(own)] if len(own) else []
                out += [(int(bucket[a]), kind, _pack(own[a:b])) for a, b in zip([0, *ends[:-1]], ends)]  # noqa: B905
            buckets, kinds, packed = zip(*out, strict=True)
            made = [pa.array(buckets, pa.int64()), pa.array([slice_] * len(buckets)), pa.array(kinds, pa.int32()), pa.array(packed, pa.binary())]
            yield pa.record_batch(made, names=["bucket", "slice", "kind", "packed"])

    return parsed.select(*_STREAMED).mapInArrow(tell, "bucket long, slice long, kind int, packed binary")


def _shared_names(sent):
    """slice, packed: of the names that a slice has sent, those that a run in two slices, or in two pages of
    one, may have, with a judged block's run among them."""

    def merge(batches):
        bucket, told = None, []

        def close():
            own = [names for _, _, names in told]
            every = np.concatenate(own)
            order = np.argsort(every, kind="stable")
            every, kind = every[order], np.repeat([k for _, k, _ in told], [len(n) for n in own])[order]
            first = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
            times, best = np.diff(np.append(first, len(every))), np.maximum.reduceat(kind, first)
            shared = every[first][(best == _FOUND) | ((times > 1) & (best == _JUDGED))]
            both = [np.intersect1d(names, shared, assume_unique=True) for names in own]
            back = [(t[0], _pack(n)) for t, n in zip(told, both, strict=True) if len(n)]
            slices, packed = zip(*back, strict=True) if back else ((), ())
            return pa.record_batch([pa.array(slices, pa.int64()), pa.array(packed, pa.binary())], names=["slice", "packed"])

        for batch in batches:
            for b, slice_, kind, packed in zip(*[batch[k].to_pylist() for k in range(3)], batch[3], strict=True):
                if b != bucket and told:
                    yield close()
                    told = []
                bucket = b
                told.append((slice_, kind, _unpack(packed.as_py())))
        if told:
            yield close()

    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(merge, "slice long, packed binary")


def _among(sorted_, values):
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values if len(sorted_) else np.zeros(len(values), bool)


def _known(back):
    return np.unique(np.concatenate([_unpack(v.as_py()) for v in back["packed"]])) if back.num_rows else np.zeros(0, np.int64)


def _met_runs(parsed, shared, run, bits, buckets):
    """bucket, slice, packed, rest: by bucket, keys of a slice's different runs with shared names, the lowest
    and highest mark of their pages, and whether a judged block has one."""
    names_, kind = ["bucket", "slice", "packed", "rest"], "bucket long, slice long, packed binary, rest binary"
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def tell(pages, back):
        wanted = _known(back)
        found = []
        for slice_, _, _, mark, judged_, past, tokens, page in _chunks(pages.to_batches(), CHUNK_TOKENS, run) if len(wanted) else ():
            at = np.flatnonzero(_among(wanted, _names(tokens, run, bits)) & (page[: len(page) - run + 1] == page[run - 1 :]))
            page_ = page[at]
            start = at - np.searchsorted(page, page_)
            found.append((_leading(tokens, run).view(np.int64)[at], mark[page_], (start < judged_[page_]) | (start >= past[page_])))
        key, mark, aim = (np.concatenate(v) for v in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        order = np.argsort(key, kind="stable")
        key, mark, aim = key[order], mark[order], aim[order]
        if not len(key):
            return pa.table([pa.array([], t) for t in types], names=names_)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        key, press, out = key[first], zstandard.ZstdCompressor(level=1), []
        low, high, aim = np.minimum.reduceat(mark, first), np.maximum.reduceat(mark, first), np.logical_or.reduceat(aim, first)
        bucket = key >> (64 - buckets)
        ends = [*np.flatnonzero(np.diff(bucket)) + 1, len(key)]
        for a, b in zip([0, *ends[:-1]], ends, strict=True):
            told = low[a:b].tobytes() + (low[a:b] ^ high[a:b]).tobytes() + aim[a:b].tobytes()
            out.append((int(bucket[a]), slice_, _pack(key[a:b]), press.compress(told)))
        return pa.table([pa.array(v, t) for v, t in zip(zip(*out, strict=True), types, strict=True)], names=names_)

    return parsed.select(*_STREAMED).groupBy("slice").cogroup(shared.groupBy("slice")).applyInArrow(tell, kind)


def _repeated_runs(sent):
    """slice, packed: keys of a slice's runs in judged blocks that pages of two marks have, wherever they lie."""

    def merge(rows):
        told, press = [], zstandard.ZstdDecompressor()
        for slice_, packed, rest in zip(rows["slice"].to_pylist(), rows["packed"], rows["rest"], strict=True):
            key, rest = _unpack(packed.as_py()), press.decompress(rest.as_py())
            low, apart = np.frombuffer(rest, np.int64, 2 * len(key)).reshape(2, -1)
            told.append((slice_, key, low, low ^ apart, np.frombuffer(rest, bool, offset=16 * len(key))))
        key, low, high = (np.concatenate([t[k] for t in told]) for k in (1, 2, 3))
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        repeated = key[first][np.minimum.reduceat(low[order], first) != np.maximum.reduceat(high[order], first)]
        both = [(slice_, own[aim & _among(repeated, own)]) for slice_, own, _, _, aim in told]
        back = [(slice_, _pack(own)) for slice_, own in both if len(own)]
        return pa.table([pa.array([v[0] for v in back], pa.int64()), pa.array([v[1] for v in back], pa.binary())], names=["slice", "packed"])

    return sent.groupBy("bucket").applyInArrow(merge, "slice long, packed binary")


def _by_slice(df, parts):
    """Write a table in Spark's buckets by slice, so that what is known of a slice joins it where it lies.

    The catalog names it only until its plan is made."""
    spark = df.sparkSession
    name, path = f"pages_{uuid.uuid4().hex}", new_folder(df.sparkSession, "pages")
    df.write.bucketBy(parts, "slice").option("compression", "zstd").option("path", path).saveAsTable(name)
    table = spark.table(name).select(*df.columns)
    spark.sql(f"DROP TABLE {name}")
    return table


def extract(pages, id="page_id", url="url", html="html", run=RUN):
    """page_id, url, text, n_chars of every page.

    A null or empty html has an empty text; a null url is a host of its own (the empty one); rows
    of one id are pages of their own. Blocks are joined by an empty line, white space inside a
    block is one space. Extra columns are ignored.
    """
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parsed = _by_slice(_parse(columns(pages, page_id=id, url=url, html=html)), parts)
    tokens = int(parsed.agg(F.sum(F.expr("aggregate(sizes, 0L, (a, n) -> a + n) + rest"))).first()[0] or 0)
    # Names are long enough for the corpus: one in some thousand is met by chance.
    bits = min(61, max(32, tokens.bit_length() + 10))
    buckets = max(6, (tokens // BUCKET_TOKENS).bit_length())
    shared = settle(_shared_names(_slice_names(parsed, run, bits, bits - buckets)), "shared")
    # Each different run of a slice once; its places are found again where its pages lie.
    back = _repeated_runs(_met_runs(parsed, shared, run, bits, buckets + 2))

    def keep(pages, back):
        wanted, covered = _known(back), {}
        for _, row, _, _, judged_, past, tokens, page in _chunks(pages.select(_STREAMED).to_batches(), CHUNK_TOKENS, run) if len(wanted) else ():
            at = np.flatnonzero(_among(wanted, _leading(tokens, run).view(np.int64)) & (page[: len(page) - run + 1] == page[run - 1 :]))
            start = at - np.searchsorted(page, page[at])
            aim = (start < judged_[page[at]]) | (start >= past[page[at]])
            start, page_ = start[aim], page[at][aim]
            ends = np.searchsorted(page_, np.arange(len(row) + 1))
            covered |= {int(row[k]): start[ends[k] : ends[k + 1]].tolist() for k in np.unique(page_).tolist()}
        texts = []
        for row, parts, sizes, rest, article in zip(*[pages[c].to_pylist() for c in ("row", "parts", "sizes", "rest", "article")], strict=True):
            gone = lost(sizes, covered[row], rest, article, run) if row in covered else ()
            texts.append("\n\n".join(without(parts, gone, article)))
        return pages.select(["page_id", "url"]).append_column("text", pa.array(texts, pa.string()))

    kind = f"page_id {parsed.schema['page_id'].dataType.simpleString()}, url string, text string"
    found = parsed.groupBy("slice").cogroup(back.groupBy("slice")).applyInArrow(keep, kind)
    return found.withColumn("n_chars", F.length("text").cast("long"))
