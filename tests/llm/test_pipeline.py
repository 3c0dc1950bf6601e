"""The registered operator queries, and the pipeline against plain computations stage by stage."""

import re

import duckdb
import public_tokenizers
import pytest
from test_pairs import brute_passages, brute_print, brute_tiles
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from placewright.llm import passages
from placewright.llm.queries import QUERIES


def test_every_operator_has_one_query():
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert names["pipeline"] is corpus_pipeline.run and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", list(QUERIES))
def test_operator_queries_cover_their_table(spark, sf, name):
    found = QUERIES[name](spark, sf).toPandas()
    key = next(k for k in ("doc_id", "page_id", "conv_id") if k in found)
    source = {"doc_id": "documents", "page_id": "pages", "conv_id": "conversations"}[key]
    want = duckdb.sql(f"select distinct {key} from '{sf}/{source}.parquet'").df()[key]
    assert set(found[key]) == set(want)


ENGLISH = "the river of that town is with them and this was not for one but all".split()
GERMAN = "der fluss und die stadt ist mit ihnen das war nicht aber wir sind alle hier".split()


def prose(words, seed, n):
    return " ".join(words[(seed * 7 + k * k * (seed + 3) + k) % len(words)] + (str(seed) if k % 3 == 0 else "") for k in range(n))


def test_pipeline_against_plain_stages(spark, tmp_path):
    item = "how many apples does the farmer sell at the market every morning before noon today"
    passage = "A passage that stands in many documents, word for word, and is long enough to be cut."
    rows = [(k, prose(ENGLISH if k % 2 else GERMAN, k, 40), "en" if k % 2 else "de") for k in range(30)]
    rows += [(40, rows[3][1], "en"), (41, None, None), (42, "12345 %% 999", "en"), (43, "", "de")]
    rows += [(44, prose(ENGLISH, 44, 20) + " " + passage, "en"), (45, prose(GERMAN, 45, 20) + "\n" + passage + " ende", "de")]
    rows += [(46, prose(ENGLISH, 46, 30) + " " + item, "en"), (47, passage, "en")]
    docs = spark.createDataFrame([(d, t, lang, "s", len(t or "")) for d, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    folder = str(tmp_path / "sf")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "nobody wrote these words into any document of this corpus")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    found = docs
    kept = {d: t for d, t, _ in rows if t and re.search(r"[^\W\d_]", t)}
    for (name, stage), want in zip(corpus_pipeline.STAGES[:4], (kept, *plain_stages(kept, item)), strict=True):
        found = stage(spark, found, folder)
        assert found.columns == docs.columns
        got = {r["doc_id"]: r["text"] for r in found.collect()}
        assert got == want, name
        assert all(r["n_chars"] == len(r["text"]) for r in found.collect())

    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = corpus_pipeline.run(spark, folder).toPandas()
    lengths = {d: len(tokens.encode(t, add_special_tokens=False).ids) + 1 for d, t in want.items()}
    assert packed.groupby("doc_id").length.sum().to_dict() == lengths
    assert packed.sequence_id.nunique() == -(-sum(lengths.values()) // 2048)


def plain_stages(kept, item):
    groups = {}
    for d in sorted(kept):
        print_ = brute_print(kept[d])
        near = next((p for p in groups if (p ^ print_).bit_count() <= 2), None)
        groups.setdefault(print_ if near is None else near, d)
    single = {d: kept[d] for d in groups.values()}
    yield single
    cut = {}
    for d, n, gone, *_ in brute_passages(list(single.items()), passages.LENGTH):
        raw, first = single[d].encode(), {}
        marks = [False] * n
        for p in range(n - passages.LENGTH + 1):
            s = raw[p : p + passages.LENGTH]
            if any(s in single[e].encode() for e in single if e < d):
                marks[p : p + passages.LENGTH] = [True] * passages.LENGTH
        assert sum(marks) == gone and not first
        left = bytes(c for c, m in zip(raw, marks, strict=True) if not m).decode("utf-8", "ignore")
        if left.strip():
            cut[d] = left
    yield cut
    words = lambda t: re.findall(r"\w+", t.lower())
    limit = 0.5 * len(words(item))
    yield {d: t for d, t in cut.items() if sum(n for n, _, _ in brute_tiles(words(item), words(t), 5)) < limit}


def test_stages_take_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, sf)
        assert found.count() == 0
