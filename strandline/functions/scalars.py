"""Scalar building blocks as columns: symbols, keywords, literals, names, numbers, bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions import dimensions as D


def callee(text: Column) -> Column:
    """The symbol that a call names in angle brackets, up to + or @; null if there is none."""
    return F.nullif(F.regexp_extract(text, r"<([^>+@]+)", 1), F.lit(""))


def keyword_flags(text: Column, keywords: list[str], prefix: str) -> list[Column]:
    """A 0/1 column for each keyword that occurs anywhere in the lower-cased text; null texts count as empty."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    return [F.contains(lower, F.lit(k)).cast("int").alias(f"{prefix}{k}") for k in keywords]


def literal_flags(text: Column) -> dict[str, Column]:
    """Classes of a string literal as booleans."""
    return {
        "s_path": F.contains(text, F.lit("/")),
        "s_syspath": text.rlike(D.SYSTEM_PATH),
        "s_shell": text.rlike(D.SHELL),
        "s_cred": text.rlike(D.CREDENTIAL),
        "s_cap": text.rlike(D.CAPABILITY),
        "s_fmt": F.contains(text, F.lit("%s")) | F.contains(text, F.lit("%d")),
    }


def token_document(text: Column, most: int = D.TOKEN_CAP) -> Column:
    """The first ``most`` runs of three or more letters or underscores, lower-cased, joined by spaces (a feature cap)."""
    return F.array_join(F.slice(F.regexp_extract_all(F.lower(text), F.lit("[a-z_]{3,}"), F.lit(0)), 1, most), " ")


def name_tokens(name: Column) -> Column:
    """Words of a snake- or camel-case name, lower-cased."""
    split = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "[^A-Za-z0-9]+", " ")
    return F.array_remove(F.split(F.lower(F.trim(split)), " +"), "")


def hash_bucket(token: Column, buckets: int = 64) -> Column:
    """The first 16 bits of sha256, modulo ``buckets``."""
    return F.conv(F.substring(F.sha2(token, 256), 1, 4), 16, 10).cast("int") % buckets


def is_small(value: Column) -> Column:
    return value.between(-16, 16)


def is_power_of_two(value: Column) -> Column:
    size = F.abs(value)
    return (size > 0) & (size.bitwiseAND(size - 1) == 0)


def immediates(text: Column, compat: bool = False) -> Column:
    """Numbers in an operand text as decimals: hexadecimal or decimal, signed. Clean mode leaves out digits that belong to
    names (r12) and keeps the sign of displacements; ``compat`` takes any digits, without signs in brackets."""
    pattern = r"(-?0x[0-9a-fA-F]+|-?\d+)" if compat else r"(?<![\w.])([+-]?0x[0-9a-fA-F]+|[+-]?\d+)(?![\w.])"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))

    def number(x):
        negative = x.startswith("-")
        bare = F.regexp_replace(x, "^[+-]", "")
        value = F.when(bare.startswith("0x"), F.conv(F.substring(bare, 3, 16), 16, 10)).otherwise(bare).cast("decimal(20,0)")
        return F.when(negative, -value).otherwise(value)

    return F.transform(found, number)


def slug(text: Column, most: int = 48) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, most)


def literal_of_immediate(digits: Column) -> Column:
    """Little-endian printable text of at least 3 characters in a hex immediate, cut at NUL; else null."""
    even = F.when(F.length(digits) % 2 == 1, F.concat(F.lit("0"), digits)).otherwise(digits)
    text = F.regexp_replace(F.reverse(F.decode(F.unhex(even), "ISO-8859-1")), "(?s)\\x00.*", "")
    return F.when(text.rlike("^[\\x20-\\x7e]{3,}$"), text)


def ends_with_path(path: Column, hint: Column) -> Column:
    """Whether a path ends in a hint, both with / for \\ and without /./ steps."""
    norm = lambda c: F.replace(F.replace(c, F.lit("\\"), F.lit("/")), F.lit("/./"), F.lit("/"))
    return F.endswith(norm(path), norm(hint))


# --- Fixed values: protocol words that are no symbols, and name prefixes that make a word a symbol hint ---------------
NO_SYMBOLS = ("SITE", "CWD", "MKD", "RMD", "DELE", "RNFR", "RNTO")
HINT_PREFIXES = ("ngx_", "vsf_", "pr_", "ssh", "userauth_", "handle_", "core_")
NO_PLACES = ("external libc/glibc",)


def clean_symbol(text: Column) -> Column:
    """A symbol without quotes and backticks, up to an arrow or bracket; null for protocol words, paths and what is no
    identifier."""
    bare = F.regexp_replace(F.trim(text), "^`+|`+$", "")
    head = F.trim(F.split_part(F.trim(F.split_part(bare, F.lit("->"), F.lit(1))), F.lit("("), F.lit(1)))
    word = F.regexp_replace(head, "^[\"' ]+|[\"' ]+$", "")
    return F.when(word.rlike("^[A-Za-z_][A-Za-z0-9_]*$") & ~word.isin(*NO_SYMBOLS), word)


def quoted_symbols(text: Column) -> Column:
    """The symbols among the chunks of a text that stand in backticks, in order."""
    return F.array_compact(F.transform(F.regexp_extract_all(text, F.lit("`([^`]+)`"), F.lit(1)), clean_symbol))


def symbol_hints(text: Column) -> Column:
    """Sorted distinct symbols that a text hints at: called or plain names in backticked lists, and words anywhere that
    begin as known families of functions do."""
    chunks = F.regexp_extract_all(text, F.lit("`([^`]+)`"), F.lit(1))
    pieces = F.transform(F.flatten(F.transform(chunks, lambda c: F.split(F.trim(c), r"\s*->\s*|,\s*"))), lambda x: F.trim(x))
    called = F.transform(pieces, lambda x: F.replace(F.regexp_extract(x, r"^([A-Za-z_][A-Za-z0-9_@.]*)\s*\(", 1), F.lit("@plt"), F.lit("")))
    plain = F.transform(F.filter(pieces, lambda x: x.rlike(r"^[A-Za-z_][A-Za-z0-9_@.()/-]*$")), lambda x: F.replace(x, F.lit("()"), F.lit("")))
    family = F.regexp_extract_all(text, F.lit(rf"\b((?:{'|'.join(HINT_PREFIXES)})[A-Za-z0-9_]*)\b"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(F.concat(called, plain, family), lambda x: x != "")))


def place_hints(text: Column) -> Column:
    """The places of a comma list as (file_hint, line_start, line_end): ``file:start-end`` or ``file:start``; other items
    are files without lines."""
    items = F.transform(F.split(text, ","), lambda x: F.regexp_replace(F.trim(x), "^`+|`+$", ""))
    items = F.filter(items, lambda x: (x != "") & ~x.isin(*NO_PLACES) & ~F.startswith(x, F.lit("stage ")))

    def parsed(x):
        pattern = r"^([^:]+):(\d+)(?:-(\d+))?$"
        start = F.nullif(F.regexp_extract(x, pattern, 2), F.lit("")).cast("int")
        end = F.nullif(F.regexp_extract(x, pattern, 3), F.lit("")).cast("int")
        return F.struct(F.when(start.isNotNull(), F.regexp_extract(x, pattern, 1)).otherwise(x).alias("file_hint"), start.alias("line_start"), F.coalesce(end, start).alias("line_end"))

    return F.transform(items, parsed)
