"""The queries opN_<name> over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.llm import decontaminate, html, language, licenses, lines, media, mixing, neardup, substrings, toxicity

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(parts: int):
    """crc32 of the id as text, modulo ``parts``. A null id is the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def op1_decontaminate(spark, sf_dir):
    """What of every document stands in the benchmark, by exact windows of ten words; n_near counts the items of which a
    window stands there with its words up to two places off."""
    found = decontaminate.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), slack=decontaminate.SLACK)
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated", "n_near")


def op2_media(spark, sf_dir):
    """Every text stored as a PNG and read back: digests of payload and image, and the cosine hash as ``feature``."""
    docs = _table(spark, sf_dir, "documents")
    done = media.to_media(docs)
    return done.withColumn("feature", F.lower(F.hex("media_hash"))).drop("media_hash")


def op3_toxicity(spark, sf_dir):
    """The toxicity score of every text, learned from labels outside the held-out fold; 1 is predicted from 0.3."""
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").filter(_fold(4) != 2).select("doc_id", "toxic")
    model = toxicity.train(docs.select("doc_id", "text").join(labels, "doc_id"))
    found = toxicity.score(docs, model)
    return found.select("doc_id", (_fold(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_licenses(spark, sf_dir):
    """Base license phrases and template blocks of every text."""
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    places = F.col("places")
    return found.select(
        "doc_id", "n_words", F.size(places).cast("bigint").alias("n_base"), F.get(places, F.lit(0)).cast("bigint").alias("first_word"),
        F.get(places, F.size(places) - 1).cast("bigint").alias("last_word"), F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score",
    )


def op5_substrings(spark, sf_dir):
    """Every text without the bytes of 400-byte strings that occur more than once; n_repeated counts the bytes of shorter
    passages that do, which stay."""
    found = substrings.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_repeated")


def op6_html(spark, sf_dir):
    """The main text of every page."""
    pages = _table(spark, sf_dir, "pages")
    return html.extract(pages, html.train(html.sample_pages(pages))).select("page_id", "url", "text", "n_chars")


def op7_neardup(spark, sf_dir):
    """Near-duplicate components of all texts, by four-word shingles at 80 hundredths."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), width=4, percent=80)


def op8_lines(spark, sf_dir):
    """Every text without repeated lines: how many it had and lost, and a digest of what is left."""
    found = lines.dedup_lines(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op9_language(spark, sf_dir):
    """The language of every text, by trees learned from documents outside the held-out fold."""
    docs = _table(spark, sf_dir, "documents")
    model = language.train(docs.filter(_fold(5) != 0))
    found = language.identify(docs, model)
    return found.select("doc_id", (_fold(5) == 0).alias("held_out"), "lang_pred", "score")


def op10_mixing(spark, sf_dir):
    """Documents replicated so that every source has the same share of characters, in a global random order."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


QUERIES |= {"op1_decontaminate": op1_decontaminate, "op2_media": op2_media, "op3_toxicity": op3_toxicity, "op4_licenses": op4_licenses, "op5_substrings": op5_substrings, "op6_html": op6_html, "op7_neardup": op7_neardup, "op8_lines": op8_lines, "op9_language": op9_language, "op10_mixing": op10_mixing}
ORACLE |= {"op4_licenses": licenses.scan_sql(), "op1_decontaminate": decontaminate.scan_sql(), "op10_mixing": mixing.mix_sql()}
