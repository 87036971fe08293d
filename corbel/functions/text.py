"""Column functions over text: words, code tokens, token estimates, safe truncation. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words the code tokenizer drops.
STOPWORDS = ["the", "a", "an", "is", "are", "was", "were", "of", "to", "in", "on", "and", "or", "it", "this", "that", "with", "as", "be", "by", "at"]


def words(text: Column) -> Column:
    """Maximal runs of letters, decimal digits and underscores; null text gives an empty array."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[_\p{L}\p{Nd}]+"), F.lit(0))


def identifier_parts(word: Column) -> Column:
    """Parts of a compound identifier: at underscores, lower-to-upper changes, and before the last capital of a run."""
    humps = F.regexp_replace(F.regexp_replace(word, r"(\p{Ll})(\p{Lu})", "$1_$2"), r"(\p{Lu})(\p{Lu}\p{Ll})", "$1_$2")
    return F.split(humps, "_+")


def tokenize_code(text: Column) -> Column:
    """Lower-case index tokens of code or prose, in order.

    A word without its outer underscores is a token; a compound identifier is kept whole and also gives its parts.
    Stopwords are dropped, but never a compound as a whole. Letters and digits are not separated. Null gives no tokens.
    """
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    inner = F.filter(F.transform(words(text), lambda w: F.regexp_replace(w, r"\A_+|_+\z", "")), lambda w: w != "")

    def expand(w: Column) -> Column:
        parts = identifier_parts(w)
        kept = F.filter(F.transform(parts, F.lower), lambda p: ~F.array_contains(stop, p))
        whole = F.array(F.lower(w))
        return F.when(F.size(parts) > 1, F.concat(whole, kept)).otherwise(F.filter(whole, lambda p: ~F.array_contains(stop, p)))

    return F.flatten(F.transform(inner, expand))


def count_tokens(text: Column) -> Column:
    """Token estimate: a quarter of each word's length, rounded up, and one for each other visible character; null is 0."""
    t = F.coalesce(text, F.lit(""))
    runs = F.aggregate(words(t), F.lit(0).cast("bigint"), lambda a, w: a + F.ceil(F.length(w) / 4))
    return (runs + F.length(F.regexp_replace(t, r"(?U)[_\p{L}\p{Nd}\s]", ""))).cast("int")


def truncate_bytes(text: Column, limit: int | Column) -> Column:
    """The longest prefix of at most ``limit`` bytes of UTF-8 that ends between two characters."""
    n = F.lit(limit) if isinstance(limit, int) else limit
    view = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")  # one character for each byte
    head = F.substring(view, F.lit(1), n)
    split = F.substring(view, n + 1, F.lit(1)).rlike(r"[\x80-\xBF]")
    whole = F.when(split, F.regexp_replace(head, r"[\xC0-\xFF][\x80-\xBF]*\z", "")).otherwise(head)
    return F.when(F.octet_length(text) <= n, text).otherwise(F.decode(F.encode(whole, "ISO-8859-1"), "UTF-8"))


def truncate_lines(text: Column, lines: int) -> Column:
    """The first ``lines`` lines."""
    return F.array_join(F.slice(F.split(text, "\n"), 1, lines), "\n")


def snippet(text: Column, lines: int, limit: int) -> Column:
    """Bounded excerpt: lines first, then bytes."""
    return truncate_bytes(truncate_lines(text, lines), limit)


def embedding_text(header: Column, text: Column) -> Column:
    """What an embedder is given: header and text on lines of their own; the text alone if there is no header."""
    return F.when(F.coalesce(header, F.lit("")) == "", text).otherwise(F.concat_ws("\n", header, text))


def index_text(header: Column, text: Column) -> Column:
    """What the lexical index is built on: header and text separated by a space."""
    return F.concat(F.coalesce(header, F.lit("")), F.lit(" "), F.coalesce(text, F.lit("")))


def truncate_to_tokens(text: Column, limit: int) -> Column:
    """Texts estimated above ``limit`` tokens are cut to four bytes for each of them."""
    return F.when(count_tokens(text) > limit, truncate_bytes(text, 4 * limit)).otherwise(text)


def squeeze(text: Column) -> Column:
    """White space runs made single spaces, ends dropped."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def slice_lines(text: Column, start: Column, count: int) -> Column:
    """At most ``count`` lines from line ``start`` (1-based) on."""
    return F.array_join(F.slice(F.split(text, "\n"), F.greatest(start, F.lit(1)), F.lit(count)), "\n")
