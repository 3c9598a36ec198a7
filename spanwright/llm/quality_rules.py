"""Document quality by weak supervision, in DataFrame functions only.

Rules look at counts of a text and vote good, bad or abstain. Expectation-maximisation over the table of vote
patterns (at most 3**rules rows, whatever the corpus) estimates the share of good documents and, for documents of
either kind, how often each rule votes bad, abstains and votes good. It starts from the plain verdict that a bad vote
makes a document doubtful, and is then free: nothing bounds an estimate but PRIOR pseudo-documents of each kind, which
keep a vote that nobody cast from meaning certainty. So a rule whose bad votes fall on documents that all others find
good loses its say. A document is kept if the posterior probability that it is good is at least a half.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.llm.common import WORD_BREAKS, settled

#: Fixed characters of the symbol count, and those that count as punctuation or digits.
SYMBOLS = "#*$%&|<>"
MARKS = SYMBOLS + "0123456789.,;:!?\"'()[]{}/\\_=+~^@`-"

#: Rules as (name, bad, good): votes where the condition holds, in this order; else the rule abstains. Conditions
#: are in integers, and Spark and other SQL engines read them alike.
RULES: list[tuple[str, str, str]] = [
    ("symbols", "100 * n_symbols > 10 * n_words", "100 * n_symbols <= 2 * n_words"),
    ("table", "100 * n_bars > 5 * n_words", "n_bars = 0"),
    ("capitals", "100 * n_capital_words > 50 * n_words", "100 * n_capital_words <= 20 * n_words"),
    ("shouting", "100 * n_exclaims > 20 * n_words", "100 * n_exclaims <= 5 * n_words"),
    ("marks", "100 * n_marks > 30 * word_chars", "100 * n_marks < 12 * word_chars"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines", "n_dup_lines = 0"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words", "100 * n_repeat_words < 5 * n_words"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words", "word_chars between 3 * n_words and 10 * n_words"),
    ("sentences", "n_stops = 0", "100 * n_stops between 2 * n_words and 40 * n_words"),
    ("variety", "100 * n_distinct_words < 15 * n_words", "100 * n_distinct_words >= 30 * n_words"),
]
#: A document fails without a vote under this many words, or over this percentage of words in repeated windows.
MIN_WORDS, MAX_REPEATED = 50, 50
#: Rounds of the estimation; it settles to four decimals within 12 on the driver's tables.
ROUNDS = 25
#: The first guess that a document is good, with a bad vote and without; pseudo-documents of each kind, and their
#: share of good ones and rates of votes by (kind, vote).
DOUBTFUL, UNDOUBTED, PRIOR, GOOD = 0.1, 0.95, 10, 0.9
RATES: dict[tuple[str, str], float] = {("good", "bad"): 0.02, ("good", "good"): 0.7, ("bad", "bad"): 0.4, ("bad", "good"): 0.2}

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bars", "n_exclaims", "n_marks", "n_stops", "n_lines", "n_distinct_words", "n_capital_words"]


def _occurrences(text: Column, characters: str) -> Column:
    rest = F.translate(text, characters, "") if len(characters) > 1 else F.replace(text, F.lit(characters), F.lit(""))
    return F.length(text) - F.length(rest)


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts that the rules look at; null text counts as empty. All are per-row expressions."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    out = docs.withColumn("_text", whole).withColumn("_words", F.array_remove(F.split("_text", "[\\x20\\x09-\\x0D]+"), ""))
    out = out.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda line: F.translate(line, WORD_BREAKS, "") != ""))
    out = out.withColumn("n_words", F.size("_words").cast("long"))
    # a word triple's hash beside its place, sorted: equal triples become neighbours
    out = out.withColumn("_triples", F.expr("sort_array(slice(transform(_words, (w, i) -> struct(xxhash64(w, get(_words, i + 1), get(_words, i + 2)) as h, i as p)), 1, greatest(n_words - 2, 0)))"))
    out = out.withColumn("_places", F.expr("sort_array(transform(filter(transform(_triples, (t, i) -> if(t.h = get(_triples, i - 1).h or t.h = get(_triples, i + 1).h, t.p, -1)), p -> p >= 0), p -> p))"))
    longs = {
        "word_chars": F.length(F.translate("_text", WORD_BREAKS, "")),
        "n_symbols": _occurrences(F.col("_text"), SYMBOLS),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.expr("aggregate(transform(_places, (p, i) -> if(i = 0, 3, least(3, p - get(_places, i - 1)))), 0, (a, x) -> a + x)"),
        "n_bars": _occurrences(F.col("_text"), "|"),
        "n_exclaims": _occurrences(F.col("_text"), "!"),
        "n_marks": _occurrences(F.col("_text"), MARKS),
        "n_stops": _occurrences(F.col("_text"), "."),
        "n_lines": F.size("_lines"),
        "n_distinct_words": F.size(F.array_distinct("_words")),
        "n_capital_words": F.expr("size(filter(_words, w -> w = upper(w) and w <> lower(w)))"),
    }
    return out.withColumns({k: v.cast("long") for k, v in longs.items()}).drop("_text", "_words", "_lines", "_triples", "_places")


Rates = dict[tuple[str, str, str], float]


def _posterior(good: float, rates: Rates) -> Column:
    def side(kind: str) -> list[Column]:
        each = ((F.col(f"vote_{n}"), rates[n, kind, "bad"], rates[n, kind, "good"]) for n, _, _ in RULES)
        return [F.when(vote == -1, F.lit(b)).when(vote == 1, F.lit(g)).otherwise(F.lit(1 - b - g)) for vote, b, g in each]

    is_good, is_bad = (reduce(lambda a, b: a * b, [F.lit(p), *side(kind)]) for p, kind in ((good, "good"), (1 - good, "bad")))
    return is_good / (is_good + is_bad)


def estimate(votes: DataFrame) -> tuple[float, Rates]:
    """The share of good documents and each rule's rates, from all rows' votes; an empty table gives the prior's.

    Votes are counted by pattern; the few patterns make one row, on which an ``aggregate`` over the rounds carries
    the estimates from step to step, so the whole fit is one SQL expression.
    """
    names = [n for n, _, _ in RULES]
    cells = [(n, kind, vote) for n in names for kind, vote in RATES]
    patterns = votes.groupBy(*(f"vote_{n}" for n in names)).agg(F.count("*").cast("double").alias("n"))
    row = patterns.agg(F.sort_array(F.collect_list(F.struct(F.array(*(f"vote_{n}" for n in names)).alias("v"), "n"))).alias("t"))

    def place(kind: str, vote: str) -> str:
        return f"s[1 + {len(RATES)} * j + {list(RATES).index((kind, vote))}]"

    def side(kind: str, share: str) -> str:
        bad, good = place(kind, "bad"), place(kind, "good")
        return f"aggregate(transform(x.v, (w, j) -> case w when -1 then {bad} when 1 then {good} else 1 - {bad} - {good} end), {share}, (a, f) -> a * f)"

    def total(kind: str, rule: str = "") -> str:
        weight = "x.n * x.p" if kind == "good" else "x.n * (1 - x.p)"
        return f"aggregate(q, 0D, (a, x) -> a + {f'if({rule}, {weight}, 0D)' if rule else weight})"

    def rated(patterns: str) -> str:
        """The estimates from q, patterns with their n and probability p of being good."""
        each = ", ".join(f"({total(kind, f'x.v[j] = {1 if vote == "good" else -1}')} + {PRIOR * rate}D) / ({total(kind)} + {PRIOR}D)" for (kind, vote), rate in RATES.items())
        share = f"({total('good')} + {PRIOR * GOOD}D) / ({total('good')} + {total('bad')} + {PRIOR}D)"
        return f"transform(array({patterns}), q -> concat(array({share}), flatten(transform(sequence(0, {len(names) - 1}), j -> array({each})))))[0]"

    start = f"transform(t, x -> struct(x.v as v, x.n as n, if(exists(x.v, w -> w = -1), {DOUBTFUL}D, {UNDOUBTED}D) as p))"
    sides = f"transform(t, x -> struct(x.v as v, x.n as n, {side('good', 's[0]')} as g, {side('bad', '1 - s[0]')} as b))"
    again = f"transform({sides}, x -> struct(x.v as v, x.n as n, x.g / (x.g + x.b) as p))"
    fit = row.select(F.expr(f"aggregate(sequence(1, {ROUNDS}), {rated(start)}, (s, k) -> {rated(again)})").alias("s")).first()["s"]
    return fit[0], dict(zip(cells, fit[1:], strict=True))


def _voted(counted: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumns({f"vote_{n}": F.when(F.expr(bad), -1).when(F.expr(fine), 1).otherwise(0) for n, bad, fine in RULES})


def passing(docs: DataFrame) -> DataFrame:
    """The rows of docs that ``judged`` would keep, with their columns as they are; rows and votes are written once, texts not shuffled."""
    boxed = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    # filters are not pushed below a generator, where the optimizer would repeat the counts for each use of a vote
    counted = with_counts(boxed).select(F.explode(F.array(F.struct("row", *COUNTS))).alias("c")).select("c.*")
    votes = [f"vote_{n}" for n, _, _ in RULES]
    voted = settled(_voted(counted).filter("not base_failed").select("row", *votes))
    return voted.filter(_posterior(*estimate(voted)) >= 0.5).select("row.*")


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, COUNTS, base_failed, quality, kept for each row of docs(doc_id, text), repeated rows included.

    Documents that fail the base rule are not kept; they take no part in the estimates. Null or empty text has no
    words and fails. quality is the posterior probability, 0 where the base rule fails. doc_id may be null and is
    only carried. Other columns are ignored; an empty table gives an empty result.
    """
    counted = settled(with_counts(docs.select("doc_id", "text")).drop("text"))
    voted = _voted(counted)
    posterior = _posterior(*estimate(voted.filter("not base_failed")))
    quality = F.when(F.col("base_failed"), 0.0).otherwise(posterior)
    return voted.withColumn("quality", quality).withColumn("kept", F.col("quality") >= 0.5).select("doc_id", *COUNTS, "base_failed", "quality", "kept")


def oracle_sql() -> str:
    """The same in DuckDB's SQL over a view ``documents``, without the posterior's value."""

    def cte() -> Iterator[str]:
        names = [n for n, _, _ in RULES]

        def drop(chars: str) -> str:
            return f"length(t) - length(translate(t, {_quoted(chars)}, ''))"

        yield "texts as (select doc_id, coalesce(text, '') as t from documents)"
        yield r"split as (select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from texts)"
        yield "triples as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from split))"
        yield "again as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as c from triples) where c > 1)"
        yield "covered as (select doc_id, count(distinct i + k) as n from again, (values (0), (1), (2)) as v(k) group by doc_id)"
        yield (
            "counts as (select s.doc_id, len(w) as n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) as word_chars, "
            f"{drop(SYMBOLS)} as n_symbols, len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words, {drop('|')} as n_bars, {drop('!')} as n_exclaims, "
            f"{drop(MARKS)} as n_marks, {drop('.')} as n_stops, len(l) as n_lines, len(list_distinct(w)) as n_distinct_words, "
            "len(list_filter(w, lambda x: x = upper(x) and x <> lower(x))) as n_capital_words from split s left join covered c on c.doc_id = s.doc_id)"
        )
        yield f"based as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEATED} * n_words as base_failed from counts)"
        yield "voted as (select *, " + ", ".join(f"case when {bad} then -1 when {good} then 1 else 0 end as vote_{n}" for n, bad, good in RULES) + " from based)"
        yield "patterns as materialized (select " + ", ".join(f"vote_{n}" for n in names) + ", count(*) as n from voted where not base_failed group by all)"

        def post(alias: str) -> str:
            def side(kind: str) -> str:
                return " * ".join(f"case vote_{n} when -1 then {alias}.{n}_{kind}_bad when 1 then {alias}.{n}_{kind}_good else 1 - {alias}.{n}_{kind}_bad - {alias}.{n}_{kind}_good end" for n in names)

            return f"({alias}.good * {side('good')}) / ({alias}.good * {side('good')} + (1 - {alias}.good) * {side('bad')})"

        share = {"good": "n * p", "bad": "n * (1 - p)"}

        def cell(rule: str, kind: str, vote: str) -> str:
            cast = f"coalesce(sum(case when vote_{rule} = {1 if vote == 'good' else -1} then {share[kind]} else 0.0::double end), 0.0::double)"
            return f"({cast} + {PRIOR * RATES[kind, vote]}::double) / (coalesce(sum({share[kind]}), 0.0::double) + {PRIOR}::double) as {rule}_{kind}_{vote}"

        est = f"(coalesce(sum(n * p), 0.0::double) + {PRIOR * GOOD}::double) / (coalesce(sum(n), 0)::double + {PRIOR}::double) as good, " + ", ".join(cell(n, kind, vote) for n in names for kind, vote in RATES)
        doubt = " or ".join(f"vote_{n} = -1" for n in names)
        yield f"e0 as materialized (select {est} from (select *, case when {doubt} then {DOUBTFUL}::double else {UNDOUBTED}::double end as p from patterns))"
        for k in range(ROUNDS):
            yield f"e{k + 1} as materialized (select {est} from (select patterns.*, {post('e')} as p from patterns, e{k} e))"
        yield f"rated as (select voted.*, {post('e')} as p from voted, e{ROUNDS} e)"

    return "with " + ",\n".join(cte()) + "\nselect doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and p >= 0.5 as kept from rated"


def _quoted(chars: str) -> str:
    return "'" + chars.replace("'", "''") + "'"
