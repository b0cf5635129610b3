"""Quality rules by distribution divergence, in DataFrame functions only.

Each document has two histograms: its characters by class, and its words by the common
words of its language. Both are compared with those of the language over the whole table
by the Jensen-Shannon distance (base 2, so 0 to 1). A document goes if a distance is above
its limit and the text is long enough for that histogram to mean something; shorter texts
are judged by the base rules alone.

Defined results: a null text counts as empty (no words; the base rule of fewer than 50
words rejects it). A language that is null or not in COMMON_WORDS is compared with the
character classes of all such documents together, and not by words. Ties, repeated rows
and repeated ids are judged row by row, though each row counts in the references. A
reference with no characters or words sets no limit. An empty table gives an empty table.
quality_rules() returns only its own columns, so other columns of any name don't clash;
keep() returns the columns it was given, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, masked, words, written

#: Common words of each reference language.
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "ist", "des", "im"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "with"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "del", "se", "las", "por", "un"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "est", "que", "une"],
}
#: Character classes, each by the pattern of what is not in it. The rest is the last class.
CLASSES = {
    "lower": r"[^\p{Ll}]+",
    "upper": r"[^\p{Lu}]+",
    "digit": r"[^\p{Nd}]+",
    "space": r"[^\x20\x09-\x0D]+",
    "point": r"""[^.,;:!?'"()-]+""",
    "symbol": r"[^#*$%&|<>]+",
}
OTHER = "zz"  # the reference of all other languages
MIN_CHARS = 200
MIN_WORDS = 100
MAX_CLASS_DISTANCE = 0.28
MAX_WORD_DISTANCE = 0.25
N_COMMON = 12


def _language(lang: Column) -> Column:
    return F.when(lang.isin(*COMMON_WORDS), lang).otherwise(F.lit(OTHER))


def _by_language(lang: Column, value) -> Column:
    out = F.lit(value(None))
    for name in COMMON_WORDS:
        out = F.when(lang == name, F.lit(value(name))).otherwise(out)
    return out


def features(docs: DataFrame) -> DataFrame:
    """Add __lang, the counts of the base rules and those of both histograms."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.withColumn("__text", text).withColumn("__lang", _language(F.col("lang").cast("string"))).withColumn("__words", words(F.col("__text")))
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("__n", F.size("__words")).withColumn("__lines", lines)
    df = df.withColumn("__windows", F.when(F.col("__n") < 3, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.col("__n") - 2), lambda i: F.array_join(F.slice("__words", i, 3), " "))))
    once = F.size(F.array_distinct("__windows")) == F.size("__windows")
    df = df.withColumn("__sorted", F.when(once, F.lit(None)).otherwise(F.array_sort(F.transform("__windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))))
    # Equal windows are neighbours in the sorted array; their places, in order, each cover up to three words.
    n = F.size("__windows")
    near = F.transform("__sorted", lambda x, k: F.when(((k > 0) & (F.get("__sorted", k - 1)["w"] == x["w"])) | ((k < n - 1) & (F.get("__sorted", k + 1)["w"] == x["w"])), x["i"]))
    df = df.withColumn("__places", F.array_sort(F.array_compact(near)))
    gaps = F.zip_with(F.slice("__places", 2, F.greatest(F.size("__places") - 1, F.lit(0))), F.slice("__places", 1, F.greatest(F.size("__places") - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(3)))
    repeats = F.when(F.col("__places").isNull() | (F.size("__places") == 0), F.lit(0)).otherwise(F.aggregate(gaps, F.lit(3), lambda x, y: x + y))
    spaced = F.concat(F.lit(" "), F.array_join("__words", "  "), F.lit(" "))
    df = df.withColumn("__spaced", spaced)
    size = F.length("__text")
    counts = {name: F.length(F.regexp_replace("__text", pattern, "")) for name, pattern in CLASSES.items()}
    common = {}
    for k in range(N_COMMON):
        word = _by_language(F.col("__lang"), lambda name, k=k: f" {COMMON_WORDS[name][k]} " if name else " ")
        cut = F.octet_length("__spaced") - F.octet_length(F.replace("__spaced", word, F.lit("")))
        common[k] = F.when(F.col("__lang") == OTHER, F.lit(0)).otherwise((cut / F.octet_length(word)).cast("long"))
    return df.select(
        *[F.col(c) for c in docs.columns],
        F.col("__lang"),
        F.col("__n").cast("long").alias("__n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("__word_chars"),
        counts["symbol"].cast("long").alias("__n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("__n_dup_lines"),
        repeats.cast("long").alias("__n_repeat_words"),
        size.cast("long").alias("__n_chars"),
        *[c.cast("long").alias(f"__c_{name}") for name, c in counts.items()],
        *[c.alias(f"__w_{k}") for k, c in common.items()],
    )


def _hist(prefix: str, names, total: str) -> list[Column]:
    bins = [F.col(f"__{prefix}_{n}").cast("double") for n in names]
    rest = F.col(total).cast("double")
    for b in bins:
        rest = rest - b
    return [*bins, rest]


def _distance(bins: list[Column], total: Column, reference: list[Column]) -> Column:
    """Jensen-Shannon distance of counts to a reference of shares."""
    out = F.lit(0.0)
    for b, q in zip(bins, reference, strict=True):
        p = b / total
        m = (p + q) / 2.0
        out = out + F.when(p > 0, 0.5 * p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, 0.5 * q * F.log2(q / m)).otherwise(0.0)
    return F.sqrt(F.greatest(out, F.lit(0.0)))


def references(got: DataFrame) -> dict[str, dict[str, int]]:
    """Counts of both histograms over every row of features(), by language: at most one row for each
    of COMMON_WORDS and one for the rest, whatever the table's size."""
    sums = [f"__c_{n}" for n in CLASSES] + [f"__w_{k}" for k in range(N_COMMON)] + ["__n_chars", "__n_words"]
    rows = got.groupBy("__lang").agg(*[F.sum(c).alias(c) for c in sums]).collect()
    return {r["__lang"]: {c: r[c] or 0 for c in sums} for r in rows}


def _shares(found: dict[str, dict[str, int]], names: list[str], total: str) -> dict[str, list[float] | None]:
    out = {}
    for lang, r in found.items():
        n = float(r[total])
        parts = [float(r[c]) for c in names]
        out[lang] = [*(p / n for p in parts), (n - sum(parts)) / n] if n > 0 else None
    return out


def _judged(got: DataFrame, found: dict[str, dict[str, int]]) -> DataFrame:
    """features() with distances and verdict."""

    def column(shares, k):
        out = F.lit(None).cast("double")
        for lang, s in sorted(shares.items()):
            if s is not None:
                out = F.when(F.col("__lang") == lang, F.lit(s[k])).otherwise(out)
        return out

    by_class = _shares(found, [f"__c_{n}" for n in CLASSES], "__n_chars")
    by_word = _shares(found, [f"__w_{k}" for k in range(N_COMMON)], "__n_words")
    d_class = _distance(_hist("c", CLASSES, "__n_chars"), F.col("__n_chars").cast("double"), [column(by_class, k) for k in range(len(CLASSES) + 1)])
    d_word = _distance(_hist("w", range(N_COMMON), "__n_words"), F.col("__n_words").cast("double"), [column(by_word, k) for k in range(N_COMMON + 1)])
    got = got.withColumn("__d_class", F.when(F.col("__n_chars") >= MIN_CHARS, d_class))
    got = got.withColumn("__d_word", F.when((F.col("__n_words") >= MIN_WORDS) & (F.col("__lang") != OTHER), d_word))
    failed = (F.col("__n_words") < 50) | (100 * F.col("__n_repeat_words") > 50 * F.col("__n_words"))
    far = (F.coalesce("__d_class", F.lit(0.0)) > MAX_CLASS_DISTANCE) | (F.coalesce("__d_word", F.lit(0.0)) > MAX_WORD_DISTANCE)
    return got.withColumn("__base_failed", failed).withColumn("__kept", ~failed & ~far)


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and
    both distances where the length guards let them be judged, for every row of docs."""
    slim = features(docs.select("doc_id", "text", "lang"))
    slim = written(slim.drop("text", "lang"))  # a row of counts a document; the texts are read once
    got = _judged(slim, references(slim))
    return got.select("doc_id", *[F.col(f"__{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")], F.round("__d_class", 6).alias("class_distance"), F.round("__d_word", 6).alias("word_distance"))


def keep(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    plain, back = masked(docs, "text", "lang")
    got = written(features(plain))  # the counts are made once, for the references and the verdicts
    return back(_judged(got, references(got)).where("__kept"))


def oracle_sql() -> str:
    """The same in DuckDB."""
    lang = f"CASE WHEN lang IN ({', '.join(repr(x) for x in COMMON_WORDS)}) THEN lang ELSE '{OTHER}' END"
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    classes = ", ".join(f"length(regexp_replace(t, {quote(p)}, '', 'g')) AS c_{n}" for n, p in CLASSES.items())

    def word(k: int) -> str:
        w = "CASE lg " + " ".join(f"WHEN '{x}' THEN ' {COMMON_WORDS[x][k]} '" for x in COMMON_WORDS) + " ELSE ' ' END"
        return f"CASE WHEN lg = '{OTHER}' THEN 0 ELSE (strlen(spaced) - strlen(replace(spaced, {w}, ''))) // strlen({w}) END AS w_{k}"

    commons = ", ".join(word(k) for k in range(N_COMMON))
    c, w = [f"c_{n}" for n in CLASSES], [f"w_{k}" for k in range(N_COMMON)]

    def distance(bins: list[str], total: str) -> str:
        parts = []
        for p, q in [(f"(CAST({b} AS DOUBLE)/{total})", f"(CAST(r_{b} AS DOUBLE)/r_{total})") for b in bins] + [(f"(CAST({total} - {' - '.join(bins)} AS DOUBLE)/{total})", f"(CAST(r_{total} - {' - '.join('r_' + b for b in bins)} AS DOUBLE)/r_{total})")]:
            m = f"(({p}+{q})/2.0)"
            parts.append(f"CASE WHEN {p}>0 THEN 0.5*{p}*log2({p}/{m}) ELSE 0 END + CASE WHEN {q}>0 THEN 0.5*{q}*log2({q}/{m}) ELSE 0 END")
        return f"sqrt(greatest({' + '.join(parts)}, 0.0))"

    return f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t, {lang} AS lg FROM documents),
e AS (SELECT *, list_filter(regexp_split_to_array(t, '{GAP}'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
f AS (SELECT *, ' ' || coalesce(array_to_string(ws, '  '), '') || ' ' AS spaced, list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' ')) AS wins FROM e),
u AS (SELECT rn, unnest(wins) AS win, unnest(range(1, len(wins) + 1)) AS i FROM f),
v AS (SELECT rn, i, count(*) OVER (PARTITION BY rn, win) AS n FROM u),
x AS (SELECT rn, count(DISTINCT i + o.o) AS n_repeat_words FROM v, (VALUES (0), (1), (2)) AS o(o) WHERE n > 1 GROUP BY rn),
g AS (SELECT f.rn, doc_id, lg, len(ws) AS n_words, length(coalesce(array_to_string(ws, ''), '')) AS word_chars, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, length(t) AS n_chars, {classes}, {commons} FROM f LEFT JOIN x USING (rn)),
r AS (SELECT lg, {', '.join(f'sum({b})::BIGINT AS r_{b}' for b in [*c, *w, 'n_chars', 'n_words'])} FROM g GROUP BY lg),
j AS (SELECT g.*, CASE WHEN n_chars >= {MIN_CHARS} THEN {distance(c, 'n_chars')} END AS d_class,
  CASE WHEN n_words >= {MIN_WORDS} AND lg <> '{OTHER}' THEN {distance(w, 'n_words')} END AS d_word,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM g JOIN r USING (lg))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, c_symbol::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (coalesce(d_class, 0) > {MAX_CLASS_DISTANCE} OR coalesce(d_word, 0) > {MAX_WORD_DISTANCE}) AS kept,
  round(d_class, 6) AS class_distance, round(d_word, 6) AS word_distance FROM j
"""
