"""Text analysis as column expressions: everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .wordlists import STOP_WORDS, SYNONYMS

#: Fixed value: the token pattern; ASCII only, so other letters split words.
TOKEN = r"([A-Z][a-z0-9]*|[a-z0-9]+|[A-Z]+)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def raw_tokens(text) -> Column:
    """Lower-cased tokens; null text has none."""
    found = F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(TOKEN), F.lit(1))
    return F.transform(found, lambda t: F.lower(t))


def tokens(text) -> Column:
    """Tokens without stop words, in order, repeats kept."""
    return F.filter(raw_tokens(text), lambda t: ~t.isin(STOP_WORDS))  # becomes a hash set


def lexer_tokens(text) -> Column:
    """The secondary tokeniser: digit runs, words of letters (then digits), and single other symbols; lower case."""
    found = F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(r"(\p{N}+|\p{L}[\p{L}\p{N}]*|\S)"), F.lit(1))
    return F.transform(found, lambda t: F.lower(t))


def words_of_lexer(toks) -> Column:
    """Of ``lexer_tokens``, those of more than one character and single letters."""
    return F.filter(_col(toks), lambda t: (F.length(t) > 1) | t.rlike(r"^\p{L}$"))


def edge_ngrams(term) -> Column:
    """The term and its prefixes of 3 to min(length, 10) - 1 characters."""
    t = _col(term)
    prefixes = F.transform(F.sequence(F.lit(3), F.least(F.length(t), F.lit(10)) - 1), lambda n: F.substring(t, 1, n))
    return F.when(F.length(t) > 3, F.array_distinct(F.concat(F.array(t), prefixes))).otherwise(F.array(t))


def soundex(term) -> Column:
    """Sound code: vowels, H, W and Y separate equal codes; only A-Z count; empty where there is none."""
    letters = F.regexp_replace(F.upper(_col(term)), "[^A-Z]", "")
    digits = F.translate(letters, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "01230120022455012623010202")
    rest = F.translate(F.substring(F.regexp_replace(digits, r"(.)\1+", "$1"), 2, 1 << 30), "0", "")
    return F.when(letters == "", "").otherwise(F.rpad(F.concat(F.substring(letters, 1, 1), F.substring(rest, 1, 3)), 4, "0"))


def synonyms_of(terms) -> Column:
    """The terms, each followed by its synonyms, first occurrences only."""
    table = F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    none = F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.transform(_col(terms), lambda t: F.concat(F.array(t), F.coalesce(table[t], none)))))


def deletions(term, depth: int = 2) -> Column:
    """The term with up to ``depth`` characters taken out: two terms within that edit distance share one of these."""

    def less(words: Column) -> Column:
        one = lambda w: F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, 1, i - 1), F.substring(w, i + 1, F.length(w))))).otherwise(F.array(w))
        return F.array_distinct(F.concat(words, F.flatten(F.transform(words, one))))

    out = F.array(_col(term))
    for _ in range(depth):
        out = less(out)
    return out


def parts(term, n: int) -> Column:
    """The term cut into ``n`` parts of nearly one length, each with its place (from 1)."""
    t = _col(term)
    at = lambda i: F.floor(F.length(t) * i / n).cast("int")
    return F.array(*[F.struct(F.substring(t, at(i) + 1, at(i + 1) - at(i)).alias("part"), (at(i) + 1).alias("place")) for i in range(n)])


def words(text) -> Column:
    """Words between white space."""
    return F.filter(F.split(F.coalesce(_col(text), F.lit("")), r"\s+"), lambda w: w != "")


def word_chunks(text, size: int = 300, overlap: int = 50) -> Column:
    """Chunks of ``size`` words that share ``overlap``; the last ends at the last word; no words, no chunk."""
    w, step = words(text), size - overlap
    n = F.size(w)
    starts = F.sequence(F.lit(0), F.ceil((n - size) / F.lit(step)).cast("int") * step, F.lit(step))
    return F.when(n == 0, F.array().cast("array<string>")).when(n <= size, F.array(F.concat_ws(" ", w))).otherwise(F.transform(starts, lambda s: F.concat_ws(" ", F.slice(w, s + 1, size))))


def path_words(path) -> Column:
    """Search text of a file path: name, extension, then up to three folders from the nearest, with ``_ - .`` as blanks."""
    parts = F.filter(F.split(F.regexp_replace(_col(path), r"\\", "/"), "/"), lambda p: (p != "") & (p != "."))
    name = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    ext = F.regexp_extract(name, r"\.([^.]*)$", 1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    folders = F.slice(F.reverse(parts), 2, 3)
    every = F.concat(F.array(stem, ext), folders)
    return F.concat_ws(" ", F.flatten(F.transform(every, lambda p: words(F.translate(p, "_-.", "   ")))))


def valid_id(column) -> Column:
    """Not empty, at most 512 bytes, no control or replacement characters, no ``||``."""
    c = _col(column)
    return F.coalesce((F.length(c) > 0) & (F.octet_length(c) <= 512) & ~c.rlike("[\\x00-\\x1f\\ufffd]") & ~c.contains("||"), F.lit(False))


def valid_text(column) -> Column:
    return F.coalesce(_col(column).rlike(r"\S"), F.lit(False))


def sanitised(column) -> Column:
    """Without NUL and what stands for invalid bytes."""
    return F.regexp_replace(_col(column), "[\\x00\\ufffd]", "")


def chunk_id(doc, page, index) -> Column:
    return F.format_string("%s||p%d||c%d||text||0.00,0.00,0.00,0.00", _col(doc).cast("string"), _col(page), _col(index))


def parsed_chunk_id(column) -> Column:
    """Struct of ``orig_id, page, idx, bbox``; missing or bad parts are 0 or null."""
    p = F.split(_col(column), r"\|\|")
    at = lambda i: F.coalesce(F.get(p, F.lit(i)), F.lit(""))
    number = lambda i, c: F.when(at(i).startswith(c), F.coalesce(F.substring(at(i), 2, 20).try_cast("int"), F.lit(0))).otherwise(F.lit(0))
    box = F.split(at(4), ",")
    return F.struct(at(0).alias("orig_id"), number(1, "p").alias("page"), number(2, "c").alias("idx"), F.when(F.size(box) == 4, F.transform(box, lambda x: F.coalesce(x.try_cast("float"), F.lit(0.0).cast("float")))).alias("bbox"))


def chunk_fields(column) -> Column:
    """Map of the parts of a chunk id that has exactly five, else null."""
    p = F.split(_col(column), r"\|\|", 5)
    return F.when(F.size(p) == 5, F.create_map(F.lit("doc_id"), p[0], F.lit("page"), p[1], F.lit("chunk"), p[2], F.lit("type"), p[3], F.lit("bbox"), p[4]))


def normalised_score(score, largest) -> Column:
    """Score over the largest, within 0 and 1; not finite, negative or without a positive largest is 0."""
    x = _col(score) / F.nullif(_col(largest).cast("double"), F.lit(0.0))
    usable = (_col(largest) > 0) & ~F.isnan(x) & (F.abs(x) != float("inf")) & (x >= 0)
    return F.when(~F.coalesce(usable, F.lit(False)), 0.0).when(x > 1, 1.0).otherwise(x)
