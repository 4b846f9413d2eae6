"""Line dedup: fuzzy lines, with DataFrame functions alone.

Lines are normalised to their words, and equal ones are one node before anything is compared. Each node has a 64-bit
SimHash of its distinct words, in which a word weighs by the square of its length, so that short and common words, which
most lines share, do not decide the bits. Two nodes are candidates if at most K bits differ: by the pigeonhole principle they then
agree on at least B - K of B blocks of bits, so all choices of B - K blocks are join keys, and none is missed.

K of 64 bits are little for a short line, so the same is done with blocks of words: two lines of the same length, or of
lengths one apart, are linked too if they agree on all of B blocks of words but one, where a block has no more words than
the edits that the line is allowed. That holds every pair of lines a single edit apart. Candidates by bits are verified by
edit similarity over words, and one occurrence of each connected group is kept.

All lines of a bucket of words differ within one block alone, and so are links of each other: each is drawn to the least of
them. Buckets of bits may hold lines that are no links: those of two nodes are one pair, larger ones name heads, and what
is then left in different components is compared pair by pair, where many are left only if they share a rare run of words.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import bucket_components, merged, scoped, small, stored, stored_and

BITS, K = 64, 3
SIMILARITY = 0.8
#: Words of fewer letters weigh nothing, and letters beyond the second number add nothing.
FEW_LETTERS, LETTERS = 4, 16
#: Tables up to so many rows are broadcast, after they have been counted: of a key and a place each, and of one key.
BROADCAST_ROWS, KEY_ROWS = 300_000, 2_000_000
#: Nodes of left-over buckets of more nodes than these are compared where they share a run of words (see run_keys).
HOT_NODES = 16
#: Where no run is sure to be shared, buckets are cut by more bits: the number of lines for which those are chosen.
FINE = 1 << 40
#: Lines of up to so many letters weigh less than 2^20: a letter counts LETTERS at most.
SHORT = (1 << 20) // LETTERS - 1
#: Halves of lines are told apart by so many words of them.
HALF_WORDS = 16
#: What stands between words, line feeds apart. One by one, as Java looks up listed characters but tests ranges in turn.
_GAP = "[" + "".join(f"\\x{c:02X}" for c in range(128) if c != 10 and not chr(c).isdigit() and not chr(c).islower()) + "]+"


def simhashes(nodes: DataFrame) -> DataFrame:
    """(node, sig) of lines (node, line): a bit is set if words of more than half the weight have it. A word counts
    once, however often a line repeats it, as else lines that repeat the same words would all be alike. Lines without a
    word of FEW_LETTERS have no SimHash.

    Hashes are added up in 22 longs, which have three lanes of 21 bits but for the last; for lines of more than SHORT
    letters, which could fill those, in a long for each bit.
    """
    short = F.length("line") <= SHORT
    return _added(nodes.filter(short), 21).unionByName(_added(nodes.filter(~short), 63))


def _added(lines: DataFrame, width: int) -> DataFrame:
    """(node, sig) of lines whose weight is below the highest bit of a lane of ``width`` bits. All lanes of a long are
    compared with half the weight at once: else the code is more than Java compiles."""
    held = 63 // width * width
    ones = lambda j: sum(1 << at for at in range(0, held if j < held else 1, width))
    nodes = lines.groupBy("node").agg(F.first("line").alias("line"))
    word = nodes.select("node", F.explode(F.array_distinct(F.split("line", " "))).alias("x")).filter(F.length("x") >= FEW_LETTERS)
    letters = F.least(F.length("x"), F.lit(LETTERS)).cast("bigint")
    h = word.select("node", F.xxhash64("x").alias("h"), (letters * letters).alias("q"))
    longs = [*range(width if held > width else BITS), *(range(held, BITS) if held > width else ())]
    sums = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(ones(j))) * F.col("q")).alias(f"s{j}") for j in longs]
    counted = h.groupBy("node").agg(F.sum("q").alias("n"), *sums)
    # a lane is over half the weight if this much more sets its highest bit
    more = F.lit((1 << width - 1) - 1) - F.shiftrightunsigned("n", 1)
    over = lambda j: F.shiftrightunsigned(F.col(f"s{j}") + more * F.lit(ones(j)), width - 1).bitwiseAND(F.lit(ones(j)))
    return counted.select("node", reduce(lambda x, y: x.bitwiseOR(y), (F.shiftleft(over(j), j) for j in longs)).alias("sig"))


def split_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, at, node, m, line): the lines of each text that have words, by number from 0, as their m words in lower
    case with single spaces, and the hash of that; row: the text's hash."""
    plain = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.regexp_replace(F.lower(text_col), _GAP, " ").alias("t"))
    cut = plain.select("id", "row", F.posexplode(F.split("t", "\n")).alias("at", "line")).withColumn("line", F.trim("line")).filter("line <> ''")
    m = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    return cut.select("id", "row", "at", F.xxhash64("line").alias("node"), m.alias("m"), "line")


def blocks(lines: int, k: int = K) -> tuple[list[int], int]:
    """The blocks of bits, and how many of them a key has: all but k, cut so that a key has about four bits more than the
    number of lines. Which number of blocks is taken changes the work but not what is found."""
    need = max(1, lines).bit_length() + 4
    b = next((b for b in range(k + 2, 14) if BITS * (b - k) // b >= need), 13)
    edges = [BITS * i // b for i in range(b + 1)]
    return [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)], b - k


def masks(lines: int, k: int = K) -> list[int]:
    """The bits of each join key: every choice of B - k of B blocks."""
    cut, held = blocks(lines, k)
    return [sum(c) for c in combinations(cut, held)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


OF_BITS, OF_WORDS = 0, 1  # what the last bit of a key says


def _kind() -> Column:
    return F.col("key").bitwiseAND(F.lit(1))


def _of_kind(key: Column, kind: int) -> Column:
    return key.bitwiseAND(F.lit(-2)).bitwiseOR(F.lit(kind))


def _bit_key(sig: Column, mask: Column) -> Column:
    return _of_kind(F.xxhash64(sig.bitwiseAND(mask), mask), OF_BITS)


def _literal(made: list[int]) -> Column:
    """Masks as one constant: an expression for each of hundreds would be planned, printed and compiled by the driver."""
    return F.array(*(F.lit(_signed(m)) for m in made))


def bit_keys(sigs: DataFrame, lines: int, k: int = K) -> DataFrame:
    """``sigs`` (sig and other columns) with a key for each choice of blocks of bits."""
    each = sigs.select("*", F.explode(_literal(masks(lines, k))).alias("__sl_mask"))
    return each.select(*sigs.columns, _bit_key(F.col("sig"), F.col("__sl_mask")).alias("key"))


def first_key(x: Column, y: Column, lines: int, k: int = K) -> Column:
    """The key of the first choice of blocks that two SimHashes agree on, which is that of the first blocks they agree on:
    of all buckets that hold both, one. Null if they agree on too few blocks, as none of at most ``k`` different bits do."""
    cut, held = blocks(lines, k)
    none = F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("mask"))
    agree = lambda found, m: (x.bitwiseXOR(y).bitwiseAND(m) == 0) & (found["n"] < held)
    step = lambda found, m: F.when(agree(found, m), F.struct((found["n"] + 1).alias("n"), found["mask"].bitwiseOR(m).alias("mask"))).otherwise(found)
    return F.aggregate(_literal(cut), none, step, lambda found: F.when(found["n"] == held, _bit_key(x, found["mask"])))


def edits_allowed(n: Column, similarity: float) -> Column:
    """Of the longer of two lines of words."""
    return F.floor((1 - similarity) * n + 1e-9).cast("int")


def word_keys(lines: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(key, node) of lines (node, m, line): a hash of all words outside each block, for the line's length and, as the
    shorter line of a pair, for one word more. A block has no more words than edits are allowed."""
    n_blocks = lambda n: F.when(edits_allowed(n, similarity) > 0, F.ceil(n / F.greatest(edits_allowed(n, similarity), F.lit(1))).cast("int")).otherwise(0)
    m = F.col("m")
    asked = lines.select("node", "line", "m", n_blocks(m).alias("own"), n_blocks(m + 1).alias("more")).filter("own + more > 0")
    each = asked.select("node", "line", "m", "own", "more", F.explode(F.sequence(F.lit(0), F.col("own") + F.col("more") - 1)).alias("x"))
    as_own = F.col("x") < F.col("own")
    each = each.select("node", "line", F.when(as_own, F.col("m")).otherwise(F.col("m") + 1).alias("n"), F.when(as_own, F.col("own")).otherwise(F.col("more")).alias("b"), F.when(as_own, F.col("x")).otherwise(F.col("x") - F.col("own")).alias("i"))
    before = F.floor(F.col("i") * F.col("n") / F.col("b")).cast("int")
    after = F.col("n") - F.floor((F.col("i") + 1) * F.col("n") / F.col("b")).cast("int")
    part = lambda count: F.call_function("substring_index", F.col("line"), F.lit(" "), count)
    return each.select(_of_kind(F.xxhash64("n", "i", part(before), part(-after)), OF_WORDS).alias("key"), "node")


def half_keys(lines: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(key, node) of lines (node, m, line): two lines that share one of their word_keys() share one of these, which are fewer.
    Of the words outside a block half stand before it or half after it, so that many first or last words are alike."""
    m = F.col("m")
    held = lambda n: F.when(edits_allowed(n, similarity) > 0, F.least(F.ceil((n - edits_allowed(n, similarity)) / 2).cast("int"), F.lit(HALF_WORDS)))
    counts = F.array_distinct(F.array_compact(F.array(held(m), held(m + 1))))
    each = lines.select("node", "line", F.explode(counts).alias("c")).select("node", "line", F.explode(F.array(F.col("c"), -F.col("c"))).alias("c"))
    return each.select(F.xxhash64("c", F.call_function("substring_index", F.col("line"), F.lit(" "), F.col("c"))).alias("key"), "node")


def shortest(edits: int, similarity: float = SIMILARITY) -> int:
    """The fewest words of a line that so many edits may link with another."""
    allowed = lambda n: int((1 - similarity) * n + 1e-9)
    return next((n - allowed(n) for n in range(1, 1000) if allowed(n) >= edits), 900) if similarity < 1 else 1 << 30


def run_length(similarity: float) -> int:
    """Of how many words the runs are of which linked lines are sure to share one: an edit changes as many runs. 0: none is sure."""
    allowed = lambda n: int((1 - similarity) * n + 1e-9)
    return next((q for q in (2, 1) if all(n - q + 1 > q * allowed(n) for n in range(1, 1000) if allowed(n))), 0)


def run_keys(lines: DataFrame, similarity: float, q: int) -> DataFrame:
    """(key, node) of distinct lines (node, m, line): a hash of each of the rarest runs of ``q`` words, as many that two linked
    lines share one. Of the runs of a line all but q for each edit stand in the other, so the q for each edit and one more
    that come first in an order of all runs do. Runs that a line repeats are numbered."""
    w = F.split("line", " ")
    at = F.sequence(F.lit(1), F.col("m") - (q - 1))
    run = lines.filter(F.col("m") >= q).select("node", "m", F.explode(F.transform(at, lambda i: F.xxhash64(F.slice(w, i, q)))).alias("run"))
    each = run.groupBy("node", "m", "run").count().select("node", "m", F.explode(F.transform(F.sequence(F.lit(1), F.col("count").cast("int")), lambda i: F.xxhash64("run", i))).alias("key"))
    each = stored(each, "line-all-runs")
    often = each.groupBy("key").agg(F.count("*").alias("often"))
    # the longer line of a pair, which sets the edits, has at most m / similarity words
    taken = q * F.floor((1 - similarity) / similarity * F.col("m") + 1e-6) + 1
    place = F.row_number().over(Window.partitionBy("node").orderBy("often", "key"))
    return each.join(often, "key").withColumn("place", place).filter(F.col("place") <= taken).select("key", "node")


def _codes(line: Column) -> Column:
    """Words as one character each (2^20 kinds by hash, all beyond 16 bits, as pairs of surrogates), so that edits of words are
    edits of characters. Of fewer kinds long lines would hold two words of one, which costs the numbers of _verifier()."""
    pair = lambda h: (F.shiftrightunsigned(h, 54) + 0xD800) * 65536 + F.shiftrightunsigned(h, 44).bitwiseAND(F.lit(0x3FF)) + 0xDC00
    return _characters(F.transform(F.split(line, " "), lambda x: pair(F.xxhash64(x, F.lit(8)))))


def _characters(codes: Column) -> Column:
    return F.decode(F.unhex(F.array_join(F.transform(codes, lambda x: F.hex(x)), "")), "UTF-16BE")


def _verifier(texts: DataFrame, similarity: float):
    """Those pairs (a, b) whose ``texts`` (node, line, coded) have at least the edit similarity over words.

    Edits of codes are never more than those of words. Where words of one pair share a code, the words of that pair are
    numbered, so that the edits of numbers decide (pairs of up to 20,000 different words, else codes do).
    """

    def verify(pairs: DataFrame) -> DataFrame:
        own = lambda c: texts.select(F.col("node").alias(c), F.col("line").alias(f"l{c}"), F.col("coded").alias(f"c{c}"))
        most = f"cast(floor((1 - {similarity}) * greatest(length(ca), length(cb)) + 1e-9) as int)"
        met = pairs.select("a", "b").join(own("a"), "a").join(own("b"), "b")
        # as many places that differ are edits enough; only where they are more is the edit distance taken
        apart = f"case when length(ca) = length(cb) then size(filter(zip_with(split(ca, ''), split(cb, ''), (x, y) -> x <> y), d -> d)) end"
        met = met.filter(f"abs(length(ca) - length(cb)) <= {most}").filter(f"coalesce({apart} <= {most}, false) or levenshtein(ca, cb, {most}) between 0 and {most}")
        met = met.withColumn("wa", F.split("la", " ")).withColumn("wb", F.split("lb", " "))
        kinds = F.array_distinct(F.concat("wa", "wb"))
        numbered = lambda w: _characters(F.transform(w, lambda x: (F.array_position(kinds, x) + 0x4E00).cast("int")))
        alike = F.size(kinds) == F.size(F.array_distinct(F.split(F.concat("ca", "cb"), "")))
        sure = F.when(alike | (F.size(kinds) > 20_000), F.lit(True)).otherwise(F.levenshtein(numbered(F.col("wa")), numbered(F.col("wb"))) <= F.expr(most))
        return met.filter(sure).select("a", "b")

    return verify


@scoped
def line_groups(lines: DataFrame, similarity: float = SIMILARITY, k: int = K) -> DataFrame:
    """(key, keeper): for each distinct line that stands in several places of ``lines`` (as split_lines() has them), or is
    linked with others, the first place (id, row, at) of its connected group."""
    spark = lines.sparkSession
    worded = lines.filter(F.col("m") >= shortest(1, similarity)).select("node", "m", "line")
    near = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= k
    # lines a single edit apart share a key of words, so bits are asked only of lines that may be linked by more
    sigs, n = stored_and(simhashes(worded.filter(F.col("m") >= shortest(2, similarity))), "line-hashes")
    met = bit_keys(sigs.select("sig"), n, k).groupBy("key").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi"), F.count("*").alias("n"))
    met = stored(met.filter((F.col("n") > 2) | (F.col("n") == 2) & near(F.col("lo"), F.col("hi"))), "line-buckets")
    # buckets of more than two are few: their keys pick their nodes, from the hashes again
    by_bits = bit_keys(sigs, n, k).join(small(met.filter("n > 2").select("key"), KEY_ROWS), "key", "left_semi")
    members = stored(by_bits.select("key", F.pmod(F.shiftright("key", 1), F.lit(4)).cast("int").alias("band"), "node", "sig", F.lit(0).alias("weight")), "line-members")
    two = met.filter("n = 2").select("lo", "hi").distinct()
    ends = stored(sigs.join(small(two.select(F.explode(F.array("lo", "hi")).alias("sig")).distinct(), KEY_ROWS), "sig", "left_semi").select("node", "sig"), "line-ends")
    own = lambda sig, c: ends.select(F.col("sig").alias(sig), F.col("node").alias(c))
    pairs = two.join(own("lo", "x"), "lo").join(own("hi", "y"), "hi").filter("lo <> hi or x < y")
    pairs = stored(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), "line-pairs")
    asked = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(members.select("node")).distinct(), "line-asked")
    # only lines that share a half with another can share the rest of their words with one
    halves = half_keys(worded, similarity).groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi")
    halves = stored(halves.select("key"), "line-halves")
    alike = stored(half_keys(worded, similarity).join(small(halves, KEY_ROWS), "key", "left_semi").select("node").distinct(), "line-alike")
    picked = alike.withColumn("half", F.lit(True)).unionByName(asked.withColumn("half", F.lit(False)))
    picked = stored(picked.groupBy("node").agg(F.max("half").alias("half"), (~F.min("half")).alias("asked")), "line-picked")
    texts = worded.join(small(picked, KEY_ROWS), "node")
    texts = stored(texts.groupBy("node").agg(*(F.first(c).alias(c) for c in ("m", "line", "half", "asked"))), "line-texts")
    halved = texts.filter("half")
    buckets = word_keys(halved, similarity).groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("n")).filter("lo < hi")
    buckets = stored(buckets, "line-word-buckets")
    drawn = word_keys(halved, similarity).join(small(buckets.filter("n > 2").select("key", "lo"), KEY_ROWS), "key").filter("lo < node")
    sure = buckets.filter("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b")).unionByName(drawn.select(F.col("lo").alias("a"), F.col("node").alias("b")))
    comps = merged(spark.createDataFrame([], "node bigint, comp bigint"), sure.distinct())
    verify = _verifier(stored(texts.filter("asked").select("node", "line", _codes(F.col("line")).alias("coded")), "line-coded"), similarity)

    def rest(now: DataFrame) -> DataFrame:
        sized = now.join(now.groupBy("key").agg(F.count("*").alias("n")), "key")
        hot = stored(sized.filter(F.col("n") > HOT_NODES).select("node", "sig", "comp").distinct(), "line-hot")

        def met(rows: DataFrame, once=None) -> DataFrame:
            other = rows.select("key", F.col("node").alias("b"), F.col("comp").alias("b_comp"), F.col("sig").alias("b_sig"))
            left = rows.join(other, "key").filter((F.col("comp") < F.col("b_comp")) & near(F.col("sig"), F.col("b_sig")))
            return (left.filter(once) if once is not None else left).select(F.col("node").alias("a"), "b")

        # a pair is met in the first of all buckets of bits that hold both
        first = lambda lines: F.col("key") == first_key(F.col("sig"), F.col("b_sig"), lines, k)
        cool = met(sized.filter(F.col("n") <= HOT_NODES).select("key", "node", "sig", "comp"), first(n))
        runs = run_length(similarity)
        if runs:
            keyed = run_keys(texts.join(small(hot.select("node"), KEY_ROWS), "node", "left_semi"), similarity, runs)
            warm = met(stored(keyed.join(hot, "node").select("key", "node", "sig", "comp"), "line-runs"))
        else:
            warm = met(bit_keys(hot, FINE, k).select("key", "node", "sig", "comp"), first(FINE))
        return verify(cool.unionByName(warm).distinct())

    side = lambda c: comps.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_comp"))
    apart = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").filter("coalesce(a_comp, a) <> coalesce(b_comp, b)")
    comps = merged(comps, verify(apart.select("a", "b")))
    comps = bucket_components(members, verify, near, rest, known=comps)
    nodes = lines.groupBy("node").agg(F.min(F.struct("id", "row", "at")).alias("first"), F.count("*").alias("n"))
    grouped = nodes.join(comps, "node", "left").filter("comp is not null or n > 1").withColumn("comp", F.coalesce("comp", "node"))
    grouped = stored(grouped, "line-grouped")
    keepers = grouped.groupBy("comp").agg(F.min("first").alias("keeper"))
    return stored(grouped.join(keepers, "comp").select(F.col("node").alias("key"), "keeper"), "line-groups", keep=True)


@scoped
def repeated_lines(docs: DataFrame, similarity: float = SIMILARITY, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, drops): for each text that loses lines their numbers."""
    lines = stored(split_lines(docs, id_col, text_col), "lines")
    groups = line_groups(lines, similarity, k)
    places = lines.select("id", "row", "at", F.col("node").alias("key"))
    dropped = places.join(small(groups, BROADCAST_ROWS), "key").filter(~F.struct("id", "row", "at").eqNullSafe(F.col("keeper")))
    return stored(dropped.groupBy("id", "row").agg(F.collect_set("at").alias("drops")), "line-drops", keep=True)


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with repeated lines taken out of the text, and n_lines and n_dropped (bigint; replaced if the
    input has columns of these names).

    Lines are what stands between line feeds. Those without a word are kept. Of each group of equal or linked lines the
    occurrence in the smallest (id, text hash, line number) is kept; a null id comes first. Linked: 1 - edits / words of
    the longer at least ``similarity``, and either SimHashes of words that differ in at most ``k`` of 64 bits, or words
    that differ within one block alone (see word_keys). Rows that repeat id and text are one occurrence and lose the same lines.
    Null texts stay null, empty texts empty, and an empty table has no rows.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    drops = repeated_lines(docs, similarity, k, id_col, text_col)
    held = docs.select(*own, F.xxhash64(text_col).alias("__sl_row"))
    gone = drops.select(F.col("id").alias("__sl_id"), F.col("row").alias("__sl_row2"), F.col("drops").alias("__sl_drops"))
    joined = held.join(gone, F.col(id_col).eqNullSafe(F.col("__sl_id")) & (F.col("__sl_row") == F.col("__sl_row2")), "left")
    cut = F.split(text_col, "\n")
    left = F.array_join(F.filter(cut, lambda x, i: ~F.array_contains("__sl_drops", i)), "\n")
    text = F.when(F.col("__sl_drops").isNull(), F.col(text_col)).otherwise(left)
    return joined.select(
        *(text.alias(c) if c == text_col else F.col(c) for c in own),
        F.coalesce(F.size(cut), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("__sl_drops"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )
