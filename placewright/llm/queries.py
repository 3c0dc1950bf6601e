"""The registered queries of this subpackage, one per operator, each over its whole table."""

import public_tokenizers

from pyspark.sql import functions as F

from . import alignment, archives, bands, languages, maintext, packing, passages, perspectives, planes, resampling, simhash, tiling, windows
from .common import new_folder, table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
QUERIES, ORACLES = {}, {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_plane_files(spark, sf_dir):
    folder = planes.write(table(spark, sf_dir, "documents"), new_folder(spark, "planes"), VOCABULARY)
    return planes.read(spark, folder)


@query
def op2_language_mixture(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(languages.bucket() == 1, F.lit(False)).alias("held_out")
    return languages.identify(docs).select("doc_id", held_out, "lang_pred", "score", "mixture")


@query
def op4_compression_bands(spark, sf_dir):
    return bands.measure(table(spark, sf_dir, "documents"))


@query
def op6_byte_index(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op3_arc_to_warc(spark, sf_dir):
    folder = archives.convert(archives.archive(table(spark, sf_dir, "pages")), new_folder(spark, "warc"))
    found = archives.read(spark, folder).where("record_type in ('response', 'revisit')")
    return found.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "date")




@query
def op9_repeated_passages(spark, sf_dir):
    return passages.find(table(spark, sf_dir, "documents"))


@query
def op8_string_tiling(spark, sf_dir):
    return tiling.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_bin_completion(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), VOCABULARY)


@query
def op10_host_suffixes(spark, sf_dir):
    return maintext.extract(table(spark, sf_dir, "pages"))


@query
def op7_perspective_rotation(spark, sf_dir):
    return perspectives.rotate(table(spark, sf_dir, "conversations"))


@query
def op11_line_resampling(spark, sf_dir):
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op12_super_kmers(spark, sf_dir):
    return windows.repeated(table(spark, sf_dir, "documents"))


@query
def op13_run_skipping(spark, sf_dir):
    return alignment.links(table(spark, sf_dir, "documents"), VOCABULARY, PIECES)


ORACLES["op7_perspective_rotation"] = perspectives.SQL
