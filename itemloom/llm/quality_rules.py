"""Quality rules: line-first cleaning, in SQL functions only.

Each line that holds a word is judged by four rules; lines that fail go, and a document that loses too much of its text
goes as a whole:

* symbols: over ``max_symbol_share`` of the line's word characters are among ``#*$%&|<>``;
* boilerplate: the line is a licence, copyright or consent notice (``BOILERPLATE``);
* navigation: three short labels or more between ``|``, ``>``, ``»``, ``•`` or ``·``, or one to three words of a menu
  (``NAVIGATION``) and nothing else;
* punctuation: the line has ``min_line_words`` words or more and no sentence mark, bracket or quote at its end.

Base rules come first: under ``min_words`` words, or over half of the words inside repeated three-word windows.

Defined results: a null text counts as empty (no words, base_failed, not kept); a null doc_id stays null; repeated rows give
repeated results; an empty table gives no rows. Only ``doc_id`` and ``text`` are read, so extra columns are ignored by
``quality_report`` and kept by ``clean_documents``. Very long texts are taken whole: all work is sorting within the row.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom.llm.common import SPACE, let
from itemloom.sources import table

SYMBOLS = "#*$%&|<>"
WORD = r"[^\x20\x09-\x0D]"
#: Notices in English, German, French and Spanish, in lower case; a line that contains one is boilerplate.
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under the", "general public license", "creative commons", "terms of use",
    "terms of service", "privacy policy", "we use cookies", "accept cookies", "accept all cookies", "enable javascript",
    "subscribe to our newsletter", "copyright (c)",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "wir verwenden cookies", "cookies akzeptieren",
    "tous droits réservés", "conditions d'utilisation", "politique de confidentialité", "nous utilisons des cookies", "accepter les cookies",
    "todos los derechos reservados", "términos de uso", "política de privacidad", "utilizamos cookies", "aceptar cookies",
)
NAVIGATION = (
    r"(?i)^[\x20\x09-\x0D]*((home|menu|login|log in|sign in|sign up|register|search|next|previous|back|back to top|skip to content|"
    r"about us|contact|contact us|share|tweet|print|read more|sitemap|startseite|anmelden|suche|weiter|kontakt|impressum|accueil|"
    r"connexion|rechercher|suivant|inicio|buscar|siguiente|anterior|contacto)[\x20\x09-\x0D|>»•·/]*){1,8}$"
)
MARKS = "|>»•·"
#: Labels between marks as one pattern, for engines whose patterns run in linear time; Java's recurses at each label, so ``only_labels`` splits.
LABELS = rf"^[^{MARKS}]{{1,30}}([\x20\x09-\x0D]+[{MARKS}][\x20\x09-\x0D]+[^{MARKS}]{{1,30}}){{2,}}$"
SENTENCE_END = tuple(".!?:;…,)]}\"'”’»。！？")
BLANKS = " \t\n\x0b\x0c\r"

MIN_WORDS = 50
MIN_LINE_WORDS = 12
MAX_SYMBOL_SHARE = 0.1
MAX_LOST_SHARE = 0.5


def word_chars(text: Column) -> Column:
    """Code points of *text* outside white space."""
    return F.char_length(F.regexp_replace(text, SPACE, ""))


def symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{SYMBOLS}]"))


def word_list(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


PLACE_BITS = 24


def _covered(places: Column) -> Column:
    """How many words the three-word windows at these places, sorted, cover: min(3, distance to the next) each."""
    steps = F.zip_with(places, F.slice(places, 2, F.greatest(F.size(places), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)).cast("int")))
    return F.aggregate(steps, F.lit(0), lambda x, y: x + y)


def _same_window(words: Column, a: Column, b: Column) -> Column:
    return (F.get(words, a) == F.get(words, b)) & (F.get(words, a + 1) == F.get(words, b + 1)) & (F.get(words, a + 2) == F.get(words, b + 2))


def _next_pairs(keys: Column, equal, place) -> Column:
    """Places of neighbours in *keys* that are equal."""
    pairs = F.zip_with(keys, F.slice(keys, 2, F.greatest(F.size(keys), F.lit(1))), lambda x, y: F.when(equal(x, y), F.struct(place(x).alias("a"), place(y).alias("b"))))
    return F.filter(pairs, lambda p: p.isNotNull())


def _places(pairs: Column) -> Column:
    return F.sort_array(F.array_distinct(F.flatten(F.transform(pairs, lambda p: F.array(p["a"], p["b"])))))


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more. *words* must be a lambda variable or a plain column.

    Each window is one long: 40 bits of its hash above its place. Sorted, equal windows stand together; neighbours of equal
    hash are compared by their words. Should one pair differ there (a collision), or a text hold 2**24 words, the windows
    themselves are sorted instead, so the count is exact either way. All of it is O(n log n) in the row, without a shuffle.
    """
    n, low = F.size(words), (1 << PLACE_BITS) - 1
    places = F.sequence(F.lit(0), n - 3)
    high = lambda x: F.shiftright(x, PLACE_BITS)
    place = lambda x: x.bitwiseAND(F.lit(low)).cast("int")
    keys = F.sort_array(F.transform(places, lambda i: F.shiftleft(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)), PLACE_BITS).bitwiseOR(i.cast("long"))))
    plain = F.sort_array(F.transform(places, lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i"))))
    by_text = let(plain, lambda s: _covered(_places(_next_pairs(s, lambda x, y: x["w"] == y["w"], lambda x: x["i"]))))
    by_hash = let(
        let(keys, lambda s: _next_pairs(s, lambda x, y: high(x) == high(y), place)),
        lambda pairs: F.when(F.size(pairs) == 0, 0).when(F.forall(pairs, lambda p: _same_window(words, p["a"], p["b"])), _covered(_places(pairs))).otherwise(by_text),
    )
    return F.when(n < 3, 0).when(n <= low, by_hash).otherwise(by_text).cast("long")


def only_labels(line: Column, most: int = 30) -> Column:
    """Whether the line is three labels or more of 1 to *most* characters, with blanks on both sides of each mark between them."""
    blank = lambda p, at: F.substring(p, at, 1).isin(*BLANKS)

    def label(p: Column, before: bool, after: bool) -> Column:
        """Of a part between marks (before, after it); blanks alone are a label if one is left over."""
        trim = F.btrim if before and after else F.ltrim if before else F.rtrim
        sides = ([blank(p, 1)] if before else []) + ([blank(p, -1)] if after else [])
        return let(trim(p, F.lit(BLANKS)), lambda own: F.when(own == "", F.char_length(p) > before + after).otherwise(reduce(and_, sides, F.char_length(own) <= most)))

    return line.rlike(f"[{MARKS}]") & let(
        F.split(line, f"[{MARKS}]"),
        lambda parts: F.when(F.size(parts) < 3, False).otherwise(
            label(F.get(parts, F.lit(0)), False, True) & label(F.element_at(parts, -1), True, False) & F.forall(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda p: label(p, True, True))
        ),
    )


def line_fails(line: Column, min_line_words: int = MIN_LINE_WORDS, max_symbol_share: float = MAX_SYMBOL_SHARE) -> Column:
    """Whether a line that holds a word fails a rule."""
    trimmed, low = F.btrim(line, F.lit(BLANKS)), F.lower(line)
    return (
        let(symbols(line), lambda n: (n > 0) & (n > F.lit(max_symbol_share) * word_chars(line)))
        | let(low, lambda x: reduce(or_, [F.contains(x, F.lit(b)) for b in BOILERPLATE]))
        | line.rlike(NAVIGATION)
        | only_labels(line)
        | (~F.substring(trimmed, -1, 1).isin(*SENTENCE_END) & (F.size(F.split(trimmed, SPACE)) >= min_line_words))
    )


def with_verdicts(docs: DataFrame, min_words: int = MIN_WORDS, max_lost_share: float = MAX_LOST_SHARE, **rules) -> DataFrame:
    """A struct ``_in`` of all columns of *docs* and a struct ``_q``: the counts, base_failed, kept and clean_text (the lines that passed, or null if none)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    good = lambda ls: F.filter(ls, lambda x: ~line_fails(x, **rules))
    counted = let(word_list(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    lined = let(lines, lambda ls: F.struct((F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"), F.array_join(good(ls), "\n").alias("clean_text")))
    got = let(
        F.struct(counted.alias("c"), lined.alias("l"), word_chars(text).cast("long").alias("n")),
        lambda x: let(
            F.struct(x.alias("x"), ((x["c"]["n_words"] < min_words) | (100 * x["c"]["n_repeat_words"] > 50 * x["c"]["n_words"])).alias("bad")),
            lambda y: F.struct(
                y["x"]["c"]["n_words"].alias("n_words"),
                y["x"]["n"].alias("word_chars"),
                symbols(text).cast("long").alias("n_symbols"),
                y["x"]["l"]["n_dup_lines"].alias("n_dup_lines"),
                y["x"]["c"]["n_repeat_words"].alias("n_repeat_words"),
                y["bad"].alias("base_failed"),
                (~y["bad"] & (word_chars(y["x"]["l"]["clean_text"]) >= (1 - max_lost_share) * y["x"]["n"])).alias("kept"),
                y["x"]["l"]["clean_text"].alias("clean_text"),
            ),
        ),
    )
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_in"), got.alias("_q"))


def quality_report(docs: DataFrame, **rules) -> DataFrame:
    """One row per document: the counts, base_failed and kept."""
    q = with_verdicts(docs.select("doc_id", "text"), **rules)
    return q.select(F.col("_in.doc_id").alias("doc_id"), *[F.col(f"_q.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def clean_documents(docs: DataFrame, **rules) -> DataFrame:
    """The kept documents with all their columns; text holds the lines that passed, n_chars (if there) their length."""
    q = with_verdicts(docs, **rules)  # a filter on _q would be pushed below it and judge every text twice; a generator is not
    q = q.withColumn("_q", F.explode(F.filter(F.array("_q"), lambda x: x["kept"])))
    new = {"text": F.col("_q.clean_text"), "n_chars": F.char_length("_q.clean_text").cast("long")}
    return q.select(*[new.get(c, F.col(f"_in.`{c}`")).alias(c) for c in docs.columns])


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


_BLANKS = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
OP4_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(text, '{SPACE}'), lambda x: x <> '') AS ws FROM d),
tri AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS t FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
again AS (SELECT rid, i FROM tri QUALIFY count(*) OVER (PARTITION BY rid, t) >= 2),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) AS o(k) GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
worded AS (SELECT rid, line, length(regexp_replace(line, '{SPACE}', '', 'g')) AS n, length(line) - length(translate(line, '{SYMBOLS}', '')) AS s FROM lines WHERE regexp_matches(line, '{WORD}')),
judged AS (
  SELECT *, s > {MAX_SYMBOL_SHARE} * n OR {" OR ".join(f"contains(lower(line), '{_sql(b)}')" for b in BOILERPLATE)} OR regexp_matches(line, '{_sql(NAVIGATION)}') OR regexp_matches(line, '{_sql(LABELS)}')
    OR (right(trim(line, {_BLANKS}), 1) NOT IN ({", ".join("'" + _sql(e) + "'" for e in SENTENCE_END)}) AND len(regexp_split_to_array(trim(line, {_BLANKS}), '{SPACE}')) >= {MIN_LINE_WORDS}) AS fails
  FROM worded),
per AS (SELECT rid, count(*) - count(DISTINCT line) AS dup, coalesce(sum(n) FILTER (WHERE NOT fails), 0) AS good FROM judged GROUP BY rid),
base AS (
  SELECT d.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(d.text, '{SPACE}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(d.text) - length(translate(d.text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(coalesce(per.dup, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, coalesce(per.good, 0) AS good
  FROM d JOIN w USING (rid) LEFT JOIN covered USING (rid) LEFT JOIN per USING (rid)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND good >= {1 - MAX_LOST_SHARE} * word_chars AS kept FROM b
"""
