"""Routing a table of issue statements.

``cases`` has case_id, issue_statement, dataset_id and baseline_id (the last two
may be null). A statement is any text, of any length: all terms are found by one
pattern in one pass over it, and the rest is read off the hits. Classifying is a
projection, the rules are a join with a table of one row per issue type.

Columns that a statement mentions are found by an inverted index: names and the
words of statements meet on equal keys, so no case is compared with the columns
it has nothing in common with.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewitness.functions.expr import (
    array_of,
    contains_any,
    fold,
    is_blank,
    literal,
    quoted,
    struct_of,
    terms_pattern,
)
from framewitness.functions.fixed import (
    CATEGORY_TERMS,
    DATE_TERMS,
    GENERAL,
    ISSUE_PRECEDENCE,
    ISSUE_TERMS,
    KEY_TERMS,
    MISSING,
    NO_PROFILE_CHECK,
    PLANNED_CHECKS,
    PLANNED_TO_EXECUTED,
    ROUTE_NAMES,
    STOP_WORDS,
    TOTAL_TERMS,
)
from framewitness.functions.wording import (
    HUMAN_CHECKS,
    HYPOTHESES,
    REVIEW_PROMPTS,
    ROUTE_CHECKS,
    ROUTE_REASONS,
)

CHECK_TYPE = (
    "STRUCT<check_id: STRING, requires_baseline: BOOLEAN, requires_raw_dataset: BOOLEAN,"
    " requires_dataset_profile: BOOLEAN, executed_as: STRING>"
)
HYPOTHESIS_TYPE = (
    "STRUCT<kind: STRING, check_ids: ARRAY<STRING>, otherwise: STRING,"
    " statement: STRING, rationale: STRING, checks: ARRAY<STRING>, daily: BOOLEAN>"
)


def _planned(issue_type: str) -> str:
    rows = [
        struct_of(
            check_id=quoted(check_id),
            requires_baseline=literal(baseline),
            requires_raw_dataset=literal(raw),
            requires_dataset_profile=literal(check_id != NO_PROFILE_CHECK),
            executed_as=quoted(PLANNED_TO_EXECUTED.get(check_id)),
        )
        for check_id, baseline, raw in PLANNED_CHECKS.get(issue_type, ())
    ]
    return f"CAST(array({', '.join(rows)}) AS ARRAY<{CHECK_TYPE}>)"


def _hypotheses(issue_type: str) -> str:
    rows = [
        struct_of(
            kind=quoted(rule["kind"]),
            check_ids=array_of(rule["check_ids"]),
            otherwise=quoted(rule["otherwise"]),
            statement=quoted(rule["statement"]),
            rationale=quoted(rule.get("rationale")),
            checks=array_of(HUMAN_CHECKS[key] for key in rule["checks"]),
            daily=literal(rule.get("daily", False)),
        )
        for rule in HYPOTHESES.get(issue_type, ())
    ]
    return f"CAST(array({', '.join(rows)}) AS ARRAY<{HYPOTHESIS_TYPE}>)"


def route_rules(spark: SparkSession) -> DataFrame:
    """The rule table: one row per issue type, eight in all."""
    rows = [
        struct_of(
            issue_type=quoted(issue_type),
            route_name=quoted(ROUTE_NAMES[issue_type]),
            route_reason=quoted(ROUTE_REASONS[issue_type]),
            planned_checks=_planned(issue_type),
            review_prompts=array_of(REVIEW_PROMPTS[issue_type]),
            hypothesis_rules=_hypotheses(issue_type),
            route_checks=array_of(
                HUMAN_CHECKS[key]
                for key in ROUTE_CHECKS.get(issue_type, ROUTE_CHECKS[GENERAL])
            ),
        )
        for issue_type in ROUTE_NAMES
    ]
    return spark.range(1).selectExpr(f"inline(array({', '.join(rows)}))")


_TERMS = [term for terms in ISSUE_TERMS.values() for term in terms]


def term_hits(folded: str) -> str:
    """All terms in the folded statement, by one pattern; each term once."""
    longest = f"array_distinct(regexp_extract_all({folded}, {quoted(terms_pattern(_TERMS))}, 1))"
    # A longer term that was found begins with shorter ones.
    shorter = {
        term: [other for other in _TERMS if term.startswith(other)] for term in _TERMS
    }
    entries = ", ".join(
        f"{quoted(term)}, {array_of(found)}"
        for term, found in shorter.items()
        if len(found) > 1
    )
    found = f"coalesce(element_at(map({entries}), t), array(t))"
    hits = f"array_distinct(flatten(transform({longest}, t -> {found})))"
    return f"coalesce({hits}, {array_of(())})"


def issue_type(folded: str, hits: str) -> str:
    """First type, in order of precedence, with a term among the hits."""
    branches = " ".join(
        f"WHEN arrays_overlap({hits}, {array_of(ISSUE_TERMS[t])}) THEN {quoted(t)}"
        for t in ISSUE_PRECEDENCE
        if t in ISSUE_TERMS
    )
    blank = is_blank(folded)
    return f"CASE WHEN {blank} THEN '{MISSING}' {branches} ELSE '{GENERAL}' END"


def matched_terms(hits: str, type_column: str = "issue_type") -> str:
    """Terms of the selected type among the hits, in list order."""
    branches = " ".join(
        f"WHEN {quoted(t)} THEN {array_of(terms)}" for t, terms in ISSUE_TERMS.items()
    )
    terms = f"CASE {type_column} {branches} ELSE {array_of(())} END"
    return f"array_intersect({terms}, {hits})"


def issue_tokens(folded: str) -> str:
    """Different words of the statement without the stop words."""
    words = f"regexp_extract_all({folded}, '([a-z0-9]+)', 1)"
    return f"array_except(coalesce({words}, {array_of(())}), {array_of(STOP_WORDS)})"


def candidate_rule(
    name: str, kind: str, mentioned: str, type_column: str = "issue_type"
) -> str:
    """Does a column belong to the candidates of the case's issue_type?

    ``mentioned`` decides for the two types that look at the words of the issue.
    """
    return f"""CASE {type_column}
        WHEN 'duplicate_key' THEN {contains_any(name, KEY_TERMS)}
        WHEN 'date_gap' THEN {kind} = 'datetime' OR {contains_any(name, DATE_TERMS)}
        WHEN 'category_shift' THEN {contains_any(name, CATEGORY_TERMS)}
        WHEN 'total_change' THEN {kind} IN ('integer', 'decimal')
            OR {contains_any(name, TOTAL_TERMS)}
        WHEN 'null_increase' THEN {mentioned}
        WHEN 'schema_change' THEN {mentioned}
        ELSE false END"""


def _once(text: str, name: str):
    """A column that no filter is pushed below, so that its text is worked out once.

    Catalyst would copy the whole expression into every filter on what comes of it.
    """
    return F.expr(f"explode_outer(array({text}))").alias(name)


def with_issue_type(cases: DataFrame) -> DataFrame:
    """Adds the folded statement, its term hits, issue_type and issue_provided."""
    return (
        cases.withColumn("lowered", F.expr("lower(issue_statement)"))
        .withColumn("folded", F.expr(fold("lowered")))
        .drop("lowered")
        .select("*", _once(term_hits("folded"), "term_hits"))
        .withColumn("issue_type", F.expr(issue_type("folded", "term_hits")))
        .withColumn("issue_provided", F.expr(f"issue_type <> '{MISSING}'"))
    )


def with_issue_words(typed: DataFrame, needed: str = "true") -> DataFrame:
    """Adds issue_tokens and issue_phrase; empty where they are not needed."""
    tokens = f"IF({needed}, {issue_tokens('folded')}, {array_of(())})"
    return typed.select("*", _once(tokens, "issue_tokens")).withColumn(
        "issue_phrase", F.expr("array_join(array_sort(issue_tokens), ' ')")
    )


def classify(cases: DataFrame) -> DataFrame:
    """Adds issue_type, classification_status, matched_terms, issue_tokens."""
    return (
        with_issue_words(with_issue_type(cases))
        .withColumn("matched_terms", F.expr(matched_terms("term_hits")))
        .withColumn(
            "classification_status",
            F.expr(f"IF(issue_provided, 'classified_for_planning', '{MISSING}')"),
        )
        .drop("folded", "term_hits")
    )


def route(cases: DataFrame) -> DataFrame:
    """Classified cases with the rules of their route.

    The rule table is a fixed eight rows, so it is always broadcast.
    """
    rules = F.broadcast(route_rules(cases.sparkSession))
    return classify(cases).join(rules, "issue_type")


def planned_checks(routed: DataFrame) -> DataFrame:
    """One row per case and planned check, with what it needs."""
    kept = [c for c in ("case_id", "issue_type", "baseline_id") if c in routed.columns]
    return (
        routed.selectExpr(*kept, "posexplode(planned_checks) AS (check_position, c)")
        .withColumn("baseline_available", F.expr("baseline_id IS NOT NULL"))
        .selectExpr(
            *kept,
            "baseline_available",
            "check_position + 1 AS check_ordinal",
            "c.check_id",
            "c.requires_baseline",
            "c.requires_raw_dataset",
            "c.requires_dataset_profile",
            "NOT c.requires_baseline OR baseline_available AS executable",
            "IF(c.requires_baseline, 'baseline_comparison', 'current_dataset_checks')"
            " AS stage",
        )
    )


def plan_inputs(routed: DataFrame) -> DataFrame:
    """Available and missing inputs of each case."""
    issue, profile, baseline = (
        "issue_provided", "dataset_id IS NOT NULL", "baseline_id IS NOT NULL",
    )
    available = f"""array_compact(array(
        IF({issue}, 'issue statement', NULL),
        IF({profile}, 'current dataset profile', NULL),
        IF({baseline}, 'baseline dataset', NULL)))"""
    missing = f"""array_compact(array(
        IF({issue}, NULL, 'issue statement'),
        IF({baseline}, NULL, 'baseline dataset or prior-run artifact')))"""
    return routed.selectExpr(
        "case_id",
        "issue_type",
        f"{baseline} AS baseline_available",
        f"{available} AS available_inputs",
        f"{missing} AS missing_inputs",
    )


# Types whose candidates are the columns that the statement mentions, and the others
# whose candidates depend on the column alone.
MENTION_TYPES = ("null_increase", "schema_change")
_NAMED_TYPES = ("duplicate_key", "date_gap", "category_shift", "total_change")


#: Names that may stand inside a word are looked up by so many of their first letters.
_GRAM = 4


def _name_keys(columns: DataFrame) -> DataFrame:
    """The index: dataset_id, how, key, name, tail, position of each column.

    A column is mentioned if a word of its name is a word of the statement (how is
    'word'), or if its name, with spaces for underscores, stands in the sorted words of
    the statement: inside one word ('inside'), or across two that follow one another
    ('across': how the first one ends and the second one begins; 'after': a name that
    takes nothing of the first one). A name that reaches over more words holds a whole
    one, which is the first case.
    """
    spoken = columns.selectExpr(
        "dataset_id",
        "position",
        "array_distinct(regexp_extract_all(folded, '([a-z0-9]+)', 1)) AS words",
        "split(replace(folded, '_', ' '), ' ', -1) AS spoken",
        "folded <> '' AND folded RLIKE '^[a-z0-9_ ]*$' AS plain",
    )
    words = "transform(words, w -> struct('word' AS how, w AS key, w AS name, '' AS tail))"
    whole = f"""CASE WHEN plain AND size(spoken) = 1
            THEN array(struct('inside' AS how, left(spoken[0], {_GRAM}) AS key,
                spoken[0] AS name, '' AS tail))
        WHEN plain AND size(spoken) = 2 AND spoken[0] = ''
            THEN array(struct('after' AS how, left(spoken[1], 1) AS key,
                spoken[1] AS name, '' AS tail))
        WHEN plain AND size(spoken) = 2
            THEN array(struct('across' AS how, right(spoken[0], 1) AS key,
                spoken[0] AS name, spoken[1] AS tail))
        ELSE array() END"""
    return spoken.selectExpr("dataset_id", "position", f"inline(concat({words}, {whole}))")


def _word_keys(words: DataFrame) -> DataFrame:
    """dataset_id, one and the keys under which names may meet a word.

    ``words`` has each different (dataset_id, one) once.
    """
    # Keys are cut from bytes, so that a long word costs its length, not its square.
    grams = words.selectExpr(
        "dataset_id", "one", "CAST(one AS BINARY) AS bytes",
        f"explode(sequence(0, {_GRAM} * length(one) - 1)) AS n",
    ).selectExpr(
        "dataset_id", "one", "'inside' AS how",
        f"CAST(substring(bytes, n DIV {_GRAM} + 1, n % {_GRAM} + 1) AS STRING) AS key",
        f"n DIV {_GRAM} + n % {_GRAM} < length(one) AS whole",
    ).filter("whole").drop("whole")
    ends = """array(struct('word' AS how, one AS key),
        struct('across' AS how, right(one, 1) AS key),
        struct('after' AS how, left(one, 1) AS key),
        struct('after' AS how, '' AS key))"""
    return words.selectExpr("dataset_id", "one", f"inline({ends})").unionByName(grams)


def _reached(index: DataFrame, words: DataFrame) -> DataFrame:
    """dataset_id, one, how, tail, position: columns that a word may mention; what stands
    before ('after') or behind it ('across': tail) decides on some."""
    met = _word_keys(words).join(index, ["dataset_id", "how", "key"])
    return met.filter(
        """CASE how WHEN 'word' THEN true
            WHEN 'inside' THEN contains(one, name)
            WHEN 'across' THEN endswith(one, name)
            ELSE startswith(one, name) END"""
    ).select("dataset_id", "one", "how", "tail", "position")


#: Bits of the filter for words that may mention a column, in numbers of 64.
_BITS = 1 << 20


def _spot(word: str) -> str:
    return f"int(pmod(xxhash64(dataset_id, {word}), {_BITS}))"


def _bit_row(reached: DataFrame) -> DataFrame:
    """One row of a fixed size: a bit for each word that was reached, by its hash."""
    marks = reached.selectExpr(f"{_spot('one')} AS spot").selectExpr(
        "spot DIV 64 AS number", "shiftleft(1L, spot % 64) AS bits"
    )
    none = reached.sparkSession.range(_BITS // 64).selectExpr("id AS number", "0L AS bits")
    numbers = marks.unionByName(none).groupBy("number").agg(F.expr("bit_or(bits) AS bits"))
    return numbers.agg(
        F.expr("transform(array_sort(collect_list(struct(number, bits))), x -> x.bits) AS filter_bits")
    )


def mentions(worded: DataFrame, columns: DataFrame) -> DataFrame:
    """dataset_id, sentence, position: the columns that each sentence mentions.

    ``worded`` has dataset_id, sentence (any key of the words) and issue_tokens, any
    number of rows for a sentence; ``columns`` has dataset_id, position and the folded
    name. A column can come more than once for a sentence. Everything is joined on
    words, and each different word of a table once, so the work grows with words and
    hits, not with cases times columns. Of the words of the sentences only those are
    shuffled that a filter of a fixed size lets through: all that reach a column, and few
    others unless very many different words do.
    """
    read = worded.filter("size(issue_tokens) > 0 AND dataset_id IS NOT NULL")
    words = read.selectExpr("dataset_id", "explode(issue_tokens) AS one").distinct()
    reached = _reached(_name_keys(columns), words)
    said = read.selectExpr("dataset_id", "sentence", "array_sort(issue_tokens) AS w").selectExpr(
        "dataset_id", "sentence",
        "inline(transform(w, (t, i) -> struct(t AS one, get(w, i + 1) AS other, i = 0 AS first)))",
    ).withColumn("spot", F.expr(_spot("one")))
    may = F.expr("getbit(get(filter_bits, spot DIV 64), spot % 64) = 1")
    left = said.join(F.broadcast(_bit_row(reached)), may)
    met = left.select("dataset_id", "sentence", "one", "other", "first").join(
        reached, ["dataset_id", "one"]
    )
    return met.filter(
        """CASE how WHEN 'across' THEN other IS NOT NULL AND startswith(other, tail)
            WHEN 'after' THEN NOT first
            ELSE true END"""
    ).select("dataset_id", "sentence", "position")


def with_sentence(worded: DataFrame) -> DataFrame:
    """Adds the key of a statement's words; statements of the same words share it."""
    return worded.withColumn("sentence", F.md5(F.col("issue_phrase")))


def reading_names(worded: DataFrame) -> DataFrame:
    """The cases whose type looks for columns that the statement mentions."""
    listed = ", ".join(quoted(t) for t in MENTION_TYPES)
    return worded.filter(f"issue_type IN ({listed})")


def folded_names(profile: DataFrame, *kept: str) -> DataFrame:
    """dataset_id, position and the folded name of each column of a profile."""
    lowered = profile.selectExpr(
        "dataset_id", "position", *kept, "lower(column_name) AS lowered"
    )
    return lowered.withColumn("folded", F.expr(fold("lowered"))).drop("lowered")


def reading_words(cases: DataFrame) -> DataFrame:
    """Classified cases with their sentence and its words; the words only where the type
    looks for columns that the statement mentions."""
    listed = ", ".join(quoted(t) for t in MENTION_TYPES)
    return with_sentence(with_issue_words(with_issue_type(cases), f"issue_type IN ({listed})"))


def candidate_columns(
    cases: DataFrame,
    profile: DataFrame,
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Candidate columns of each case, one row per case and column.

    ``keep`` may persist the classified cases, which are read more than once; without it
    the statements are classified again for every reading.
    """
    columns = folded_names(profile, "column_name", "inferred_kind")
    worded = reading_words(cases).select(
        "case_id", "issue_type", "dataset_id", "sentence", "issue_tokens"
    )
    if keep is not None:
        worded = keep(worded)
    named = ", ".join(
        f"IF({candidate_rule('folded', 'inferred_kind', 'false', quoted(t))}, {quoted(t)}, NULL)"
        for t in _NAMED_TYPES
    )
    by_type = columns.selectExpr(
        "dataset_id", "position", "column_name", f"explode(array_compact(array({named}))) AS issue_type"
    )
    reading = reading_names(worded)
    by_name = (
        reading.join(mentions(reading, columns).distinct(), ["dataset_id", "sentence"])
        .join(columns.select("dataset_id", "position", "column_name"), ["dataset_id", "position"])
    )
    out = ["case_id", "issue_type", "dataset_id", "position", "column_name"]
    return (
        worded.join(by_type, ["dataset_id", "issue_type"]).select(out).unionByName(by_name.select(out))
    )
