"""Benchmark decontamination through a stored positional inverted index, with DataFrame functions alone.

The index holds a posting (term, row, position) for every training token that is also a term of the benchmark, which is
all that its phrases can ask for. Each phrase reads the list of its rarest term first, shifts every position by the
term's offset, and intersects with the shifted list of the next rarest; what is left is met with the lists of all its
other terms, position by position, so matches are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import scoped, small, stored, words

WINDOW = 10
#: Places by which a word of a phrase may be moved in a proximity match.
SLACK = 2
#: Benchmark tables (terms, phrases) up to so many rows are broadcast after they have been counted; larger ones are
#: joined by shuffle.
BROADCAST_ROWS = 100_000


def phrases(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, phrase_at, terms): each run of ``window`` words of an item, or all its words if they are fewer but not
    none. Items that are null or hold no word have no phrase; equal items have equal phrases under each id."""
    worded = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    return worded.select("item", "w", F.explode(starts).alias("phrase_at")).select("item", "phrase_at", F.slice("w", F.col("phrase_at") + 1, window).alias("terms"))


class Index:
    """A stored index of ``docs`` for the terms of one set of phrases.

    postings: (row, doc, n_words, term, position), a row for each indexed token and, so that no document is lost, one
    with term null for each document whose first token is not a term or that has no token.
    """

    def __init__(self, postings: DataFrame, terms: DataFrame, phrase_terms: DataFrame):
        self.postings, self.terms, self.phrase_terms = postings, terms, phrase_terms


def build(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of ``docs`` for the phrases ``found``. A document is a row, so rows that share an id stay apart."""
    spelled = found.withColumn("phrase", F.monotonically_increasing_id())
    spelled = stored(spelled.select("phrase", "item", "phrase_at", F.posexplode("terms").alias("offset", "word")), "phrases")
    vocabulary = stored(spelled.select("word").distinct().select("word", F.monotonically_increasing_id().alias("term")), "terms")
    phrase_terms = spelled.join(small(vocabulary, BROADCAST_ROWS), "word").select("phrase", "item", "phrase_at", "offset", "term", "word")
    tokens = docs.select(F.col(id_col).alias("doc"), words(F.col(text_col)).alias("w")).withColumn("row", F.monotonically_increasing_id())
    tokens = tokens.select("row", "doc", F.size("w").alias("n_words"), F.posexplode_outer("w").alias("position", "word"))
    postings = tokens.join(small(vocabulary, BROADCAST_ROWS), "word", "left").filter("term is not null or coalesce(position, 0) = 0")
    postings = stored(postings.select("row", "doc", "n_words", "term", "position"), "postings")
    seen = postings.filter("term is not null").groupBy("term").agg(F.count("*").alias("seen"))
    terms = stored(vocabulary.join(seen, "term", "left").select("term", F.coalesce("seen", F.lit(0)).alias("seen")), "term-counts")
    return Index(postings, terms, stored(phrase_terms, "phrase-terms"))


def match(index: Index) -> DataFrame:
    """Exact matches: (row, doc, item, phrase_at, start, length), a row for each place where a phrase stands.

    Phrases with a term that the corpus lacks are dropped unread. The two rarest lists are intersected at their offsets;
    survivors are spelled out, one row for each (place, offset), and met with the postings.
    """
    counted = index.phrase_terms.join(small(index.terms, BROADCAST_ROWS), "term")
    whole = Window.partitionBy("phrase")
    ranked = (
        counted.withColumn("rank", F.row_number().over(whole.orderBy("seen", "term", "offset")))
        .withColumn("least", F.min("seen").over(whole))
        .withColumn("length", F.count("*").over(whole))
        .filter("least > 0")
    )
    ranked = stored(ranked.select("phrase", "item", "phrase_at", "offset", "term", "rank", "length"), "ranked")
    lists = index.postings.filter("term is not null").select("row", "doc", "n_words", "term", "position")

    def shifted(rank: int) -> DataFrame:
        """Where each phrase would start, by the list of its term of this rank."""
        own = ranked.filter(F.col("rank") == rank).select("phrase", "offset", "term", "length")
        at = lists.join(small(own, BROADCAST_ROWS), "term").withColumn("start", F.col("position") - F.col("offset"))
        return at.filter("start >= 0 and start + length <= n_words")

    first = shifted(1).select("row", "doc", "phrase", "start", "length")
    second = shifted(2).select("row", "phrase", "start")
    alone = first.filter("length = 1")
    places = stored(first.filter("length > 1").join(second, ["row", "phrase", "start"]).unionByName(alone), "places")
    # the same place of an item asks for the same words through many phrases: each (row, alignment, offset) once
    wanted = places.select("row", "phrase", "start").join(small(ranked.select("phrase", "offset", "term"), BROADCAST_ROWS), "phrase")
    wanted = wanted.select("row", (F.col("start") + F.col("offset")).alias("position"), "term").distinct()
    met = stored(lists.select("row", "position", "term").join(wanted, ["row", "position", "term"], "left_semi"), "met")
    spelled = places.join(small(ranked.select("phrase", "item", "phrase_at", "offset", "term"), BROADCAST_ROWS), "phrase")
    spelled = spelled.withColumn("position", F.col("start") + F.col("offset"))
    full = spelled.join(met, ["row", "position", "term"]).groupBy("row", "doc", "phrase", "item", "phrase_at", "start", "length").agg(F.count("*").alias("n"))
    return full.filter("n = length").select("row", "doc", "item", "phrase_at", "start", "length")


def near(index: Index, slack: int = SLACK) -> DataFrame:
    """Proximity matches: (row, doc, item, phrase_at, start): places where all terms of a phrase stand within ``slack``
    positions of where its rarest term (of ties the first by its letters, then by its place) puts them, in any order.
    Exact matches are among them.

    The lists of the two rarest terms are met first, by cells of places, so that a long document in which both are common
    is no product of the two; only what is left asks for the other terms.
    """
    counted = index.phrase_terms.join(small(index.terms, BROADCAST_ROWS), "term")
    whole = Window.partitionBy("phrase")
    ranked = counted.withColumn("rank", F.row_number().over(whole.orderBy("seen", "word", "offset"))).withColumn("least", F.min("seen").over(whole)).withColumn("length", F.count("*").over(whole)).filter("least > 0")
    ranked = stored(ranked.select("phrase", "item", "phrase_at", "offset", "term", "rank", "length"), "near-ranked")
    lists = index.postings.filter("term is not null").select("row", "doc", "term", "position")
    cell = F.floor(F.col("start") / (slack + 1))

    def shifted(rank: int) -> DataFrame:
        own = ranked.filter(F.col("rank") == rank).select("phrase", "item", "phrase_at", "length", "offset", "term")
        return lists.join(small(own, BROADCAST_ROWS), "term").withColumn("start", F.col("position") - F.col("offset"))

    first = shifted(1).select("row", "doc", "phrase", "item", "phrase_at", "length", "start")
    second = shifted(2).select("row", "phrase", F.col("start").alias("start2"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    met = first.withColumn("cell", cell).join(second, ["row", "phrase", "cell"]).filter(F.abs(F.col("start") - F.col("start2")) <= slack)
    met = stored(met.drop("cell", "start2").distinct(), "near-places")
    wide = ranked.filter("rank > 2").select("phrase", "offset", "term", F.explode(F.sequence(F.lit(-slack), F.lit(slack))).alias("shift"))
    asked = met.join(small(wide, BROADCAST_ROWS), "phrase").withColumn("position", F.col("start") + F.col("offset") + F.col("shift"))
    kept = asked.join(lists.drop("doc"), ["row", "position", "term"]).groupBy("row", "doc", "phrase", "item", "phrase_at", "start", "length").agg(F.countDistinct("offset").alias("n")).filter("n + 2 = length")
    few = met.filter("length = 2").unionByName(first.filter("length = 1"))
    columns = ["row", "doc", "item", "phrase_at", "start"]
    return kept.select(columns).unionByName(few.select(columns))


@scoped
def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", slack: int | None = None) -> DataFrame:
    """What of each document stands in the benchmark: (row, id, n_words, n_hit, items, n_items, contaminated), and with
    ``slack`` n_near, the items of which a phrase stands there with its words moved by up to so many places (see near).

    A word is hit if any exact match of any phrase covers it. ``items`` are the ids that occur, as sorted strings. Null
    and empty documents and items have no words; a null item id counts as no item but its words still hit; repeated rows
    are each reported; an empty benchmark hits nothing; an empty table gives no rows. ``row`` tells rows apart.
    """
    index = build(docs, phrases(items, window), text_col=text_col, id_col=id_col)
    found = stored(match(index), "matches")
    covered = found.select("row", F.explode(F.sequence("start", F.col("start") + F.col("length").cast("int") - 1)).alias("position")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    named = found.select("row", "item").distinct().groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    rows = index.postings.filter("coalesce(position, 0) = 0").select("row", F.col("doc").alias(id_col), F.col("n_words").cast("bigint").alias("n_words"))
    # matches are few beside documents: they are counted first and sent out only if they are few indeed
    hits = covered.join(named, "row")
    if slack is not None:
        hits = hits.join(near(index, slack).select("row", "item").distinct().groupBy("row").agg(F.count("item").alias("n_near")), "row", "full")
    hits = stored(hits, "hits")
    joined = rows.join(small(hits, BROADCAST_ROWS), "row", "left")
    found = joined.select(
        "row", id_col, "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        *([] if slack is None else [F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near")]),
    )
    return stored(found, "scanned", keep=True)


def scan_sql(docs: str = "documents", items: str = "benchmark", window: int = WINDOW, slack: int = SLACK) -> str:
    """DuckDB SQL for the digest columns of scan(), by comparing windows as strings, and places of words for n_near."""
    cut = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""
    with d as (select doc_id, {cut} as w, row_number() over () as r from {docs}),
    i as (select cast(item_id as varchar) as item, {cut} as w from {items}),
    p as (select distinct item, least(len(w), {window}) as n, array_to_string(w[s + 1:s + {window}], ' ') as phrase
      from i, unnest(range(greatest(len(w) - {window}, 0) + 1)) as t(s) where len(w) > 0),
    g as (select r, n, s, array_to_string(w[s + 1:s + n], ' ') as phrase from d, (select distinct n from p) as l, unnest(range(len(w) - n + 1)) as t(s) where len(w) >= n),
    m as (select g.r, g.s, g.n, p.item from g join p on g.phrase = p.phrase and g.n = p.n),
    h as (select r, count(distinct pos) as n_hit from m, unnest(range(s, s + n)) as t(pos) group by r),
    f as (select r, count(distinct item) as n_items, array_to_string(list_sort(list(distinct item)), ',') as items from m group by r),
    tok as (select r, unnest(w) as word, generate_subscripts(w, 1) - 1 as pos from d where len(w) > 0),
    seen as (select word, count(*) as seen from tok group by word),
    q as (select row_number() over () as phrase, item, w[s + 1:s + {window}] as t from i, unnest(range(greatest(len(w) - {window}, 0) + 1)) as u(s) where len(w) > 0),
    o as (select phrase, item, len(t) as length, unnest(t) as word, generate_subscripts(t, 1) - 1 as off from q),
    k as (select o.*, coalesce(seen, 0) as seen, min(coalesce(seen, 0)) over (partition by phrase) as least, row_number() over (partition by phrase order by coalesce(seen, 0), o.word, off) as rank from o left join seen on o.word = seen.word),
    a as (select tok.r, k.phrase, k.item, k.length, tok.pos - k.off as start from k join tok on tok.word = k.word where k.rank = 1 and k.least > 0),
    e as (select a.r, a.phrase, a.start, count(distinct k.off) as n from a join k on k.phrase = a.phrase and k.rank > 1 join tok on tok.r = a.r and tok.word = k.word and abs(tok.pos - a.start - k.off) <= {slack} group by 1, 2, 3),
    z as (select a.r, count(distinct a.item) as n_near from a left join e on a.r = e.r and a.phrase = e.phrase and a.start = e.start where coalesce(e.n, 0) + 1 = a.length group by 1)
    select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
      sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated,
      cast(coalesce(n_near, 0) as bigint) as n_near
    from d left join h on d.r = h.r left join f on d.r = f.r left join z on d.r = z.r
    """
