"""The queries over the test tables: thin, each through its operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import common
from .common import spread, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark, sf_dir):
    from . import sentencepiece

    return sentencepiece.round_trip(spread(table(spark, sf_dir, "documents")), vocabulary("piece_bpe_32k.model"))


def op2_html_text(spark, sf_dir):
    from . import htmltext

    return htmltext.extract(spread(table(spark, sf_dir, "pages")))


def op3_token_files(spark, sf_dir):
    from . import tokenids

    docs = table(spark, sf_dir, "documents")
    return tokenids.read(tokenids.write(docs, common.new_dir(spark, "token-files"), vocabulary("word_bpe_49k.json")))


def op4_packing(spark, sf_dir):
    from . import packing

    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op5_quality_rules(spark, sf_dir):
    from . import quality

    return quality.judge(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op6_warc(spark, sf_dir):
    from . import warc

    index = warc.write(table(spark, sf_dir, "pages"), common.new_dir(spark, "warc"))
    return warc.read(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_hilbert_neighbours(spark, sf_dir):
    from . import ann

    return ann.search(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op8_language_id(spark, sf_dir):
    from . import langid

    return langid.identify(spread(table(spark, sf_dir, "documents")))


def op9_near_duplicates(spark, sf_dir):
    from . import neardup

    return neardup.near_duplicates(spread(table(spark, sf_dir, "documents")))


def op10_line_dedup(spark, sf_dir):
    from . import linededup

    return linededup.remove(spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))).select("doc_id", "n_lines", "n_removed", "text")


def op11_fill_in_middle(spark, sf_dir):
    from . import fim

    out = fim.transform(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    digest = {"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(fim.restored(F.col("output"), F.col("form")), 256)}
    return out.withColumns(digest).select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", *digest)


def op12_curriculum_mix(spark, sf_dir):
    from . import mixing

    rows = mixing.planned(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source")), keep=("doc_id",))
    rows = rows.select("doc.doc_id", "size", "source_size", "target", "taken", F.round(F.get("copies", F.lit(0))["position"], 9).alias("first_position"))
    return mixing.in_order(rows, "first_position", "doc_id")


def op13_source_divergence(spark, sf_dir):
    from . import divergence

    return divergence.report(spread(table(spark, sf_dir, "documents").select("lang", "source", "text")))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from . import divergence, fim, linededup, mixing, neardup, quality, warc

    return {"op5_quality_rules": quality.oracle(), "op6_warc": warc.oracle(), "op9_near_duplicates": neardup.oracle(), "op10_line_dedup": linededup.oracle(), "op11_fill_in_middle": fim.oracle(), "op12_curriculum_mix": mixing.oracle(), "op13_source_divergence": divergence.oracle()}
