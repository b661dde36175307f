"""Queries over the driver tables, each with the SQL that states the same result.

Natural queries run on the tables' own text. The driver's text has next to no greetings, requests or sign-offs,
so others run on ``decorated`` documents: the same texts with phrases put around them, chosen by doc_id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from penprint.functions import patterns, text
from penprint.operators import dedupe, diff, drafts, edits, lexicon, metrics, registers
from penprint.plans import analyze
from penprint.sources import files, mail
from penprint.storage import scratch_path, table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


# ---- The decorated view, in both languages.

OPENERS = ["Hi Dana,", "Hey Sam,", "Priya -", "Priya,", "Team update.", "Hello Lee,"]
ASKS = ["Can you confirm by Friday?", "Need the deck by noon.", "Nothing else here.", "Please let me know.", "We shipped it."]
HEDGES = ["I think it is fine; maybe.", "They do not agree (yet)!", "It's just a bit late...", "We can't wait -- sorry to push."]
BULLETS = ["- one\n- two", "* single", "No list."]
CLOSERS = ["Best,\nDana Reyes", "Thanks", "- D", "Cheers,\nSam", "see https://ex.com/a for $4,200.00"]
FOOTERS = ["", "-- \nDana | Acme", "Sent from my phone", "Dana Reyes\ncall 415-555-0100 now", "On Mon, Sam wrote:\n> old text"]
_PARTS = [OPENERS, ASKS, HEDGES, BULLETS, CLOSERS]


def decorated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, subject, body, raw (body with a footer) of every document."""
    pick = lambda items, c: F.element_at(F.array(*[F.lit(x) for x in items]), (c % len(items) + 1).cast("int"))
    i = F.col("doc_id")
    opener, ask, hedge, bullet, closer = (pick(p, i) for p in _PARTS)
    body = F.concat(opener, F.lit("\n\n"), ask, F.lit(" "), hedge, F.lit(" "), F.col("text"), F.lit("\n\n"), bullet, F.lit("\n\n"), closer)
    docs = table(spark, sf_dir, "documents")
    subject = F.concat(pick(["re: ", "", "Invoices "], i), F.substring("text", 1, 20), pick(["?", "", "!"], F.floor(i / 3)))
    return docs.select("doc_id", "lang", "source", subject.alias("subject"), body.alias("body"), F.concat(body, F.lit("\n"), pick(FOOTERS, i)).alias("raw"))


def _sql_pick(items: list[str], c: str) -> str:
    quoted = ", ".join("'" + x.replace("'", "''").replace("\n", "'||chr(10)||'") + "'" for x in items)
    return f"list_extract([{quoted}], ({c} % {len(items)} + 1)::int)"


_BODY = " || chr(10)||chr(10) || ".join([_sql_pick(OPENERS, "doc_id"), " || ' ' || ".join([_sql_pick(ASKS, "doc_id"), _sql_pick(HEDGES, "doc_id"), "text"]), _sql_pick(BULLETS, "doc_id"), _sql_pick(CLOSERS, "doc_id")])
_SUBJECT = f"{_sql_pick(['re: ', '', 'Invoices '], 'doc_id')} || substr(text, 1, 20) || {_sql_pick(['?', '', '!'], '(doc_id // 3)')}"
DECORATED = f"decorated AS (SELECT doc_id, lang, source, {_SUBJECT} AS subject, {_BODY} AS body, {_BODY} || chr(10) || {_sql_pick(FOOTERS, 'doc_id')} AS raw FROM documents)"


# ---- SQL forms of the text functions.

_ABBREVIATIONS = "|".join(x.replace(".", r"\.") for x in patterns.ABBREVIATIONS)


def _sql_strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"


def _sql_sentences(x: str) -> str:
    masked = x
    for _ in range(2):  # neighbours overlap
        masked = rf"regexp_replace({masked}, '\b({_ABBREVIATIONS})(\s+)([A-Z0-9])', '\1'||chr(2)||'\2\3', 'g')"
    cut = rf"regexp_replace({_sql_strip(masked)}, '([.!?])\s+([A-Z0-9])', '\1'||chr(1)||'\2', 'g')"
    # A one-letter sentence ends where the next match would begin.
    cut = rf"regexp_replace({cut}, '([.!?])\s+([A-Z0-9])', '\1'||chr(1)||'\2', 'g')"
    return f"list_filter(list_transform(string_split({cut}, chr(1)), lambda s: replace({_sql_strip('s')}, chr(2), '')), lambda s: s <> '')"


def _sql_paragraphs(x: str) -> str:
    return rf"list_filter(list_transform(string_split_regex({_sql_strip(x)}, '\n\s*\n'), lambda p: {_sql_strip('p')}), lambda p: p <> '')"


def _sql_count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern.replace(chr(39), chr(39) * 2)}'))"


_WORDS = lambda x: _sql_count(x, "[A-Za-z']+")


def _sql_tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z'']+')"


def _sql_shingles(w: str) -> str:
    """w: a column of words; an expression would be computed again for every window."""
    return f"CASE WHEN len({w}) < 5 THEN [array_to_string({w}, ' ')] ELSE list_distinct(list_transform(range(1, len({w}) - 3), lambda i: array_to_string({w}[i:i+4], ' '))) END"


def _sql_quartiles(source: str, by: str) -> str:
    """by, median, low, high over rows (by, v) of ``source``."""

    def q(i: int) -> str:
        j = f"greatest(1, least(n - 1, ({i} * (n + 1)) // 4))"
        return f"(x[{j}] * (4 - ({i} * (n + 1) - 4 * {j})) + x[{j} + 1] * ({i} * (n + 1) - 4 * {j})) / 4"

    return f"""SELECT {by}, (x[(n + 1) // 2] + x[n // 2 + 1]) / 2 AS median, CASE WHEN n < 4 THEN x[1] ELSE {q(1)} END AS low,
        CASE WHEN n < 4 THEN x[n] ELSE {q(3)} END AS high FROM (SELECT {by}, list_sort(list(v::double)) AS x, count(*) AS n FROM {source} GROUP BY {by})"""


def _sql_shape_values(source: str, by: str, body: str) -> str:
    """CTEs that end in ``shapes``: by, metric, v."""
    return f"""paras AS (SELECT {by}, {body} AS b, list_transform({_sql_paragraphs(body)}, lambda p: {_sql_sentences("p")}) AS ps FROM {source}),
    sents AS (SELECT {by}, unnest(ps) AS ss FROM paras),
    shapes AS (SELECT {by}, 'words_per_email' AS metric, {_WORDS("b")} AS v FROM paras UNION ALL SELECT {by}, 'paragraphs_per_email', len(ps) FROM paras
      UNION ALL SELECT {by}, 'sentences_per_paragraph', len(ss) FROM sents UNION ALL SELECT {by}, 'words_per_sentence', {_WORDS("x")} FROM (SELECT {by}, unnest(ss) AS x FROM sents))"""


# ---- Shape, rates and shares.


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), "lang", "source", F.col("text").alias("body"))


@query(f"""WITH {_sql_shape_values("documents", "lang", "text")} {_sql_quartiles("shapes", "lang, metric")}""")
def word_shape_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.shape(_documents(spark, sf_dir), ["lang"])


_PUNCT_SQL = {"em_dash": "[—–]|--", "ellipsis": r"\.\.\.|…", "exclamation": "!", "semicolon": ";", "parenthesis": r"\(", "emoji": "[🌀-🫿☀-➿]"}
_EXPANDED_SQL = "(?i)\\b(" + "|".join(patterns.EXPANDED) + ")\\b"
_CONTRACTED_SQL = "(?i)\\b\\w+'(" + "|".join(patterns.CONTRACTED_ENDINGS) + ")\\b"


def _sql_pooled(source: str, by: str, body: str) -> str:
    rates = ", ".join(f"coalesce(sum({_sql_count(body, p)}) * 100 / nullif(sum({_WORDS(body)}), 0), 0.0)::double AS {k}" for k, p in _PUNCT_SQL.items())
    c, e = (f"sum({_sql_count(body, p)})" for p in (_CONTRACTED_SQL, _EXPANDED_SQL))
    return f"SELECT {by}, coalesce({c} / nullif({c} + {e}, 0), 0.0)::double AS contraction_rate, {rates} FROM {source} GROUP BY {by}"


@query(_sql_pooled("documents", "lang", "text"))
def punct_rates_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pooled(_documents(spark, sf_dir), ["lang"])


@query(f"WITH {DECORATED} " + _sql_pooled("decorated", "source", "body"))
def pooled_rates_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pooled(decorated(spark, sf_dir), ["source"])


_HEDGE_SQL = "(?i)\\b(" + "|".join(patterns.HEDGE_PHRASES) + ")\\b"
_IMPERATIVE_SQL = "(?i)^(" + "|".join(patterns.IMPERATIVES) + ")([^-\\w]|$)"
_ASK_SQL = "(?i)(\\?|\\b(" + "|".join(patterns.ASK_PHRASES) + "|by (" + "|".join(patterns.ASK_DEADLINES) + "))\\b)"


def _sql_stance(source: str, by: str) -> str:
    return rf"""SELECT {by}, sum(h) / sum(w) * 100 AS hedges_per_100w, sum(i) / sum(n) AS imperative_rate, sum(q) / sum(n) AS question_rate, sum(b) / sum(n) AS bullet_rate FROM
      (SELECT {by}, len(ss) AS n, len(list_filter(ss, lambda x: regexp_matches(x, '{_IMPERATIVE_SQL}'))) AS i, len(list_filter(ss, lambda x: x LIKE '%?')) AS q,
      len(list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '^\s*[-*•]\s+'))) AS b, {_sql_count("body", _HEDGE_SQL)} AS h, {_WORDS("body")} AS w FROM (SELECT {by}, body, {_sql_sentences("body")} AS ss FROM {source})) GROUP BY {by}"""


@query(f"WITH {DECORATED} {_sql_stance('decorated', 'lang')}")
def stance_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.stance(decorated(spark, sf_dir), ["lang"])


@query(
    f"""WITH {DECORATED}, s AS (SELECT doc_id, flatten(list_transform({_sql_paragraphs("body")}, lambda p: {_sql_sentences("p")})) AS ss FROM decorated),
    a AS (SELECT doc_id, ss, list_position(list_transform(ss, lambda x: regexp_matches(x, '{_ASK_SQL}') OR regexp_matches(x, '{_IMPERATIVE_SQL}')), true) AS p FROM s)
    SELECT doc_id, round((nullif(p, 0) - 1) / len(ss), 3) AS ask_placement FROM a"""
)
def ask_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decorated(spark, sf_dir).select("doc_id", text.ask_placement(F.col("body")).alias("ask_placement"))


def _sql_ask_median(source: str, by: str) -> str:
    return f"""SELECT {by}, median(round((nullif(p, 0) - 1) / len(ss), 3)) AS ask_placement_median FROM (SELECT {by}, ss, list_position(list_transform(ss, lambda x: regexp_matches(x, '{_ASK_SQL}') OR regexp_matches(x, '{_IMPERATIVE_SQL}')), true) AS p
      FROM (SELECT {by}, flatten(list_transform({_sql_paragraphs("body")}, lambda p: {_sql_sentences("p")})) AS ss FROM {source})) GROUP BY {by}"""


@query(f"WITH {DECORATED} {_sql_ask_median('decorated', 'lang')}")
def ask_median_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ask_median(decorated(spark, sf_dir), ["lang"])


_FIRST = _sql_strip(f"string_split({_sql_strip('body')}, chr(10))[1]")
_OPENER_SQL = rf"""CASE WHEN regexp_matches(f, '(?i)^hi\s+[A-Z][\w''-]*') THEN 'hi_name' WHEN regexp_matches(f, '(?i)^(hey|hello)\s+[A-Z][\w''-]*') THEN 'hey_name'
    WHEN regexp_matches(f, '^[A-Z][\w''-]*\s*[—–-](\s*$|\s+\S)') THEN 'name_dash' WHEN regexp_matches(f, '^[A-Z][\w''-]*,\s*$') THEN 'bare_name' ELSE 'none' END"""
_LINES = f"list_filter(list_transform(string_split(body, chr(10)), lambda x: {_sql_strip('x')}), lambda x: x <> '')"
_SIGNOFFS = "[" + ", ".join(f"'{s}'" for s in patterns.SIGNOFFS) + "]"
def _sql_closers(source: str, by: str) -> str:
    return rf"""SELECT {by}, coalesce(list_last(list_filter(list_transform(l[-2:], lambda x: lower(trim(regexp_replace(x, ',+$', '')))), lambda x: list_contains({_SIGNOFFS}, x))), 'none') AS closer,
      list_filter(string_split_regex(regexp_replace(trim(regexp_replace(l[-1], '^[—–-]+', '')), ',+$', ''), '\s+'), lambda x: x <> '') AS names, {_OPENER_SQL} AS opener
      FROM (SELECT {by}, {_LINES} AS l, {_FIRST} AS f FROM {source})"""


_NAME_FORM_SQL = """CASE WHEN len(names) NOT BETWEEN 1 AND 3 OR len(list_filter(names, lambda x: NOT (upper(x[1]) = x[1] AND lower(x[1]) <> x[1]))) > 0 THEN 'none'
    WHEN len(names) > 1 THEN 'full_name' WHEN length(names[1]) <= 2 THEN 'initial' ELSE 'first_name' END"""


def _sql_kinds(source: str, by: str) -> str:
    """by, kind, value, n, share."""
    return f"""SELECT {by}, kind, value, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY {by}, kind) AS share FROM
      (SELECT {by}, unnest([{{'kind': 'opener', 'value': opener}}, {{'kind': 'closer', 'value': closer}}, {{'kind': 'name_form', 'value': {_NAME_FORM_SQL}}}], recursive := true) FROM ({_sql_closers(source, by)})) GROUP BY {by}, kind, value"""


@query(f"WITH {DECORATED} {_sql_kinds('decorated', 'source')}")
def opener_closer_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.col("body")
    kinds = {"opener": text.opener(body), "closer": text.signoff(body), "name_form": text.name_form(body)}
    each = decorated(spark, sf_dir).select("source", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in kinds.items()])).alias("k")).select("source", "k.*")
    return metrics.shares(each, ["source", "kind"], F.col("value"))


def _sql_subjects(source: str, by: str) -> str:
    return rf"""SELECT {by}, median({_sql_count("subject", r"[^ \t\n\r]+")})::double AS median_words, avg((subject = lower(subject))::int) AS lowercase_rate,
      avg((regexp_replace(subject, '\s+$', '') LIKE '%?')::int) AS question_rate FROM {source} WHERE subject <> '' GROUP BY {by}"""


def _sql_flat(source: str, by: str) -> str:
    """CTEs that end in ``flat``: by, metric, value of every scalar metric. source: a CTE with by, subject and body."""
    longer = lambda of, prefix, columns: f"SELECT {by}, '{prefix}' || name AS metric, value::double AS value FROM (UNPIVOT {of} ON {', '.join(columns)} INTO NAME name VALUE value)"
    parts = [
        longer("f_pooled", "punctuation.", list(_PUNCT_SQL)),
        longer("f_pooled", "", ["contraction_rate"]),
        longer("f_stance", "stance.", ["hedges_per_100w", "imperative_rate", "question_rate", "bullet_rate"]),
        longer("f_ask", "", ["ask_placement_median"]),
        longer("f_subject", "subject.", ["median_words", "lowercase_rate", "question_rate"]),
        f"SELECT {by}, 'shape.' || metric || '.median', median FROM f_shape",
        f"SELECT {by}, CASE kind WHEN 'opener' THEN 'openers.' WHEN 'closer' THEN 'closers.' ELSE 'name_forms.' END || value, share FROM f_kinds",
    ]
    return f"""f_pooled AS ({_sql_pooled(source, by, "body")}), f_stance AS ({_sql_stance(source, by)}), f_ask AS ({_sql_ask_median(source, by)}), f_subject AS ({_sql_subjects(source, by)}),
    {_sql_shape_values(source, by, "body")}, f_shape AS ({_sql_quartiles("shapes", by + ", metric")}), f_kinds AS ({_sql_kinds(source, by)}), flat AS ({" UNION ALL ".join(parts)})"""


@query(f"WITH {DECORATED} {_sql_subjects('decorated', 'lang')}")
def subject_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.subjects(decorated(spark, sf_dir), ["lang"])


@query("SELECT lang, coalesce(sum(length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g'))) / nullif(sum(length(text)), 0), 0) < 0.15 AS english_metrics_valid FROM documents GROUP BY lang")
def english_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.english_valid(_documents(spark, sf_dir), ["lang"])


# ---- Shingles and deduplication.


@query(f"SELECT doc_id, len({_sql_shingles('w')})::int AS shingles FROM (SELECT doc_id, {_sql_tokens('text')} AS w FROM documents)")
def shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.shingles(F.col("text"))).alias("shingles"))


_SETS = f"""sets AS (SELECT doc_id, s, len(s) AS n FROM (SELECT doc_id, {_sql_shingles("w")} AS s FROM (SELECT doc_id, {_sql_tokens("text")} AS w FROM documents))),
    firsts AS (SELECT min(doc_id) AS doc_id, s, n FROM (SELECT doc_id, list_sort(s) AS s, n FROM sets) GROUP BY s, n),
    each AS (SELECT doc_id, n, unnest(s) AS x FROM firsts),
    pairs AS (SELECT a.doc_id AS "left", b.doc_id AS "right", count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS similarity FROM each a JOIN each b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2)"""


@query(f"""WITH {_SETS} SELECT "left", "right", similarity FROM pairs WHERE similarity >= 0.7""")
def near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs between representatives of equal shingle sets."""
    sets = written(dedupe.shingle_sets(table(spark, sf_dir, "documents"), "doc_id", "text"), "sets")
    _, copies = dedupe.first_sets(sets)
    return dedupe.similar_pairs(sets, copies)


# The rounds are written out: by the fourth, every chain of these tables is decided.
def _sql_rounds(n: int) -> str:
    out = f'e0 AS (SELECT "left" AS l, "right" AS r FROM pairs WHERE similarity >= 0.7), gone0 AS (SELECT 0::bigint AS id WHERE false)'
    for i in range(n):
        out += f""", goes{i} AS (SELECT DISTINCT r AS id FROM e{i} WHERE l NOT IN (SELECT r FROM e{i})),
        gone{i + 1} AS (SELECT id FROM gone{i} UNION SELECT id FROM goes{i}),
        e{i + 1} AS (SELECT l, r FROM e{i} WHERE l NOT IN (SELECT id FROM gone{i + 1}) AND r NOT IN (SELECT id FROM gone{i + 1}))"""
    return out


@query(f"WITH {_SETS}, {_sql_rounds(6)} SELECT doc_id AS key FROM firsts WHERE doc_id NOT IN (SELECT id FROM gone6)")
def dedupe_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.kept_keys(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    """SELECT count(*) AS raw, count(*) FILTER (WHERE n < 15) AS terse, count(*) FILTER (WHERE n >= 15) AS kept, count(*) FILTER (WHERE n = 0) AS empty
    FROM (SELECT len(regexp_extract_all(text, '\\S+')) AS n FROM conversations)"""
)
def terse_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "conversations").select(text.n_blank_words(F.col("text")).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("raw"), F.count_if(F.col("n") < patterns.TERSE_WORDS).alias("terse"), F.count_if(F.col("n") >= patterns.TERSE_WORDS).alias("kept"), F.count_if(F.col("n") == 0).alias("empty"))


# ---- Registers: a customer is a domain, an order a message.

_DOMAIN = "CASE WHEN o_custkey % 7 = 0 THEN 'own.com' WHEN o_custkey % 7 = 1 THEN 'gmail.com' ELSE 'c' || o_custkey || '.com' END"


def _order_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_custkey")
    domain = F.when(key % 7 == 0, "own.com").when(key % 7 == 1, "gmail.com").otherwise(F.concat(F.lit("c"), key.cast("string"), F.lit(".com")))
    subject = F.when(F.col("o_orderkey") % 11 == 0, "Invoices due").otherwise(F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ord"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.array(domain).alias("to_domains"), (F.col("o_orderkey") % 5 == 0).alias("is_reply"), subject.alias("subject")
    )


_REGISTERS = f"""m AS (SELECT o_orderkey AS ord, strftime(o_orderdate, '%Y-%m-%d') AS date, {_DOMAIN} AS d, o_orderkey % 5 = 0 AS is_reply, CASE WHEN o_orderkey % 11 = 0 THEN 'Invoices due' ELSE o_orderpriority END AS subject FROM orders),
    f AS (SELECT *, NOT (d NOT IN ('own.com', 'gmail.com') AND row_number() OVER (PARTITION BY d ORDER BY date, ord) > 1) AND NOT is_reply AS first_contact FROM m),
    r AS (SELECT ord, first_contact, CASE WHEN d = 'own.com' THEN 'internal' WHEN d = 'gmail.com' THEN 'personal' WHEN contains(lower(subject), 'invoices') THEN 'vendor' WHEN first_contact THEN 'cold_outreach' ELSE 'client' END AS register FROM f)"""


@query(f"WITH {_REGISTERS} SELECT ord, first_contact, register FROM r")
def first_contact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registers.assigned(_order_messages(spark, sf_dir), "own.com").select("ord", "first_contact", "register")


@query(f"WITH {_REGISTERS} SELECT register, count(*) AS messages, count(*) < 8 AS suppressed FROM r GROUP BY register")
def register_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registers.counted(registers.assigned(_order_messages(spark, sf_dir), "own.com"))


@query(
    f"""WITH {DECORATED}, m AS (SELECT *, {_sql_count("body", r"[^ \t\n\r\x0b\x0c]+")} AS wc FROM decorated), g AS (SELECT lang AS l, median(wc) AS med FROM m GROUP BY lang),
    s AS (SELECT lang, doc_id, wc, CASE WHEN regexp_matches(body, '{_ASK_SQL}') THEN 1.0 ELSE 0.0 END::double + CASE WHEN len({_sql_paragraphs("body")}) > 1 THEN 0.3 ELSE 0.0 END::double - abs(wc - med) / CASE WHEN med = 0 THEN 1 ELSE med END AS score FROM m JOIN g ON lang = l)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id)::int AS rank, doc_id, wc::int AS word_count FROM s QUALIFY rank <= 4"""
)
def exemplars_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decorated(spark, sf_dir).withColumn("word_count", text.n_blank_words(F.col("body")))
    return registers.exemplars(rows, "lang", "doc_id").select("lang", "rank", "doc_id", "word_count")


# ---- Lexicon.

_GRAMS = """w AS (SELECT source, doc_id, lang, list_transform(regexp_extract_all(text, '[A-Za-z'']+'), lambda x: lower(x)) AS w FROM documents),
    g AS (SELECT lang, source, 1 AS n, unnest(w) AS phrase FROM w UNION ALL SELECT lang, source, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w WHERE len(w) > 1)"""


@query(
    f"""WITH {_GRAMS}, base AS (SELECT n AS bn, phrase AS bp, count(*) / sum(count(*)) OVER (PARTITION BY n) AS freq FROM g GROUP BY n, phrase),
    c AS (SELECT lang, n, phrase, count(*) AS count, sum(count(*)) OVER (PARTITION BY lang, n) AS total FROM g GROUP BY lang, n, phrase)
    SELECT lang, n, phrase, count, round(ln(count / total / coalesce(freq, 1e-7)), 6) AS log_odds FROM c LEFT JOIN base ON n = bn AND phrase = bp WHERE count >= 3"""
)
def lexicon_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-odds of every phrase of a language against all documents."""
    counts = written(lexicon.phrase_counts(_documents(spark, sf_dir), ["lang"]), "phrases")
    scored = lexicon.scores(counts, lexicon.frequencies(counts), ["lang"])
    return scored.select("lang", "n", "phrase", "count", F.round("log_odds", 6).alias("log_odds"))


@query(
    """WITH w AS (SELECT source, doc_id, list_transform(regexp_extract_all(text, '[A-Za-z'']+'), lambda x: lower(x)) AS w FROM documents),
    g AS (SELECT source, 1 AS n, doc_id, unnest(range(len(w))) AS pos, unnest(w) AS phrase FROM w
      UNION ALL SELECT source, 2, doc_id, unnest(range(len(w) - 1)), unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w WHERE len(w) > 1),
    base AS (SELECT n AS bn, phrase AS bp, count(*) / sum(count(*)) OVER (PARTITION BY n) AS freq FROM g GROUP BY n, phrase),
    c AS (SELECT source, n, phrase, count(*) AS count, sum(count(*)) OVER (PARTITION BY source, n) AS total, min({'d': doc_id, 'p': pos}) AS first FROM g GROUP BY source, n, phrase),
    s AS (SELECT *, ln(count / total / coalesce(freq, 1e-7)) AS odds FROM c LEFT JOIN base ON n = bn AND phrase = bp WHERE count >= 3)
    SELECT source, row_number() OVER (PARTITION BY source ORDER BY round(odds, 3) DESC, n, first)::int AS rank, n, phrase, count, round(odds, 6) AS log_odds FROM s QUALIFY rank <= 15"""
)
def lexicon_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top phrases of each source: ties of rounded scores go by first occurrence."""
    docs = _documents(spark, sf_dir)
    counts = written(lexicon.phrase_counts(docs, ["source"]), "phrases")
    return lexicon.lexicon(docs, lexicon.frequencies(counts), ["source"], counts=counts).withColumn("log_odds", F.round("log_odds", 6))


@query(f"WITH {_GRAMS} SELECT n, phrase, count(*) / sum(count(*)) OVER (PARTITION BY n) AS freq FROM g GROUP BY n, phrase")
def baseline_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.baseline_of(_documents(spark, sf_dir))


# ---- Redaction and cleaning.

PLACES = ["meet at 12 Main Street today", "ring +1 415 555 0100 at once", "Dear Priya and Dana-Lee", "write to lee.k@mail.example.co now", "or www.ex.com/x?y=1"]
_PRIVATE = ["[EMAIL]", "[URL]", "[$AMOUNT]", "[PHONE]", "[ADDRESS]", "[FIRST]"]


def _sql_redacted(x: str) -> str:
    """CTEs that end in ``red``: doc_id, t, the redacted ``x`` of decorated; Dana stays (masked, as the SQL dialect has no lookahead)."""
    out = f"replace({x}, 'Dana', chr(3))"
    for pattern, put in (
        (r"\b[\w.+-]+@[\w-]+\.[\w.]+\b", "[EMAIL]"),
        (r"https?://\S+|\bwww\.\S+", "[URL]"),
        (r"\$\s?\d[\d,]*(\.\d\d)?\b", "[$AMOUNT]"),
        (r"(^|[^\w])(\+?\d[\d\s().-]{8,}\d)($|[^\w])", r"\1[PHONE]\3"),
        (r"\b\d{1,5}\s+[A-Z][a-z]+\s+(Street|St|Avenue|Ave|Road|Rd|Blvd)\b", "[ADDRESS]"),
    ):
        out = f"regexp_replace({out}, '{pattern}', '{put}', 'g')"
    kept = ", ".join(f"'{w}'" for w in patterns.WEEKDAYS_MONTHS)
    others = ", ".join(f"'{w}'" for w in patterns.NOT_NAMES)
    greeting = rf"""CASE WHEN regexp_matches(x, '^(Hi|Hey|Hello|Dear)\s+[A-Z][\w''-]+') AND lower(regexp_extract(x, '^(Hi|Hey|Hello|Dear)\s+([A-Z][\w''-]+)', 2)) NOT IN ({kept})
        THEN regexp_replace(x, '^(Hi|Hey|Hello|Dear)\s+[A-Z][\w''-]+', '\1 [FIRST]') ELSE x END"""
    bare = rf"""CASE WHEN regexp_matches(l[1], '^[ \t]*[A-Z][\w''-]*([ \t]*,[ \t]*[A-Z][\w''-]*)*[ \t]*,[ \t]*$') AND len(list_filter(string_split(rtrim(l[1], ', '), ','), lambda n: trim(lower(n)) IN ({others}))) = 0
        THEN list_concat([array_to_string(list_transform(list_filter(string_split(rtrim(l[1], ', '), ','), lambda n: trim(n) <> ''), lambda n: '[FIRST]'), ', ') || ','], l[2:]) ELSE l END"""
    closing = r"(?m)^(Best regards|Best|Thanks|Cheers|Regards|Sincerely),?\s*\n\s*[A-Z][\w''-]+(\s+[A-Z][\w''-]+)?\s*$"
    return rf"""r1 AS (SELECT doc_id, list_transform(string_split({out}, chr(10)), lambda x: {greeting}) AS l FROM decorated), r2 AS (SELECT doc_id, array_to_string({bare}, chr(10)) AS t FROM r1),
    red AS (SELECT doc_id, replace(regexp_replace(t, '{closing}', '\1,' || chr(10) || '[FIRST]', 'g'), chr(3), 'Dana') AS t FROM r2)"""


@query(
    f"""WITH {DECORATED}, {_sql_redacted("raw || chr(10) || " + _sql_pick(PLACES, "(doc_id // 7)"))}
    SELECT doc_id, md5(t) AS digest, {", ".join(f"((length(t) - length(replace(t, '{k}', ''))) // {len(k)})::bigint AS {k.strip('[$]').lower()}" for k in _PRIVATE)} FROM red"""
)
def redact_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the redacted text (Dana stays), and how many placeholders of each kind it has."""
    place = F.element_at(F.array(*[F.lit(x) for x in PLACES]), (F.floor(F.col("doc_id") / 7) % len(PLACES) + 1).cast("int"))
    out = decorated(spark, sf_dir).select("doc_id", text.redacted(F.concat("raw", F.lit("\n"), place), ["Dana"]).alias("t"))
    n = lambda k: F.floor((F.length("t") - F.length(F.replace("t", F.lit(k), F.lit("")))) / len(k)).cast("bigint").alias(k.strip("[$]").lower())
    return out.select("doc_id", F.md5(F.col("t").cast("binary")).alias("digest"), *[n(k) for k in _PRIVATE])


_QUOTED_SQL = r"(?m)(^On .{0,200}\bwrote:\s*$|^-{2,}\s*(?i:Original Message)\s*-{2,}\s*$|^_{10,}\s*$|^From:\s.+\nSent:\s.+$|^\s*>)(?s:.*)"


def _sql_unquoted(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '{_QUOTED_SQL}', ''), '\s+$', '')"


@query(f"WITH {DECORATED} SELECT doc_id, md5({_sql_unquoted('raw')}) AS digest FROM decorated")
def quote_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decorated(spark, sf_dir).select("doc_id", F.md5(text.without_quotes(F.col("raw")).cast("binary")).alias("digest"))


_CONTACT_SQL = r"(?i)\+?\d[\d\s().-]{7,}\d|\b[\w.+-]+@[\w-]+\.\w+\b|\b[\w-]+\.(com|net|org|io|co)\b|\|"


def _sql_unsigned(source: str, x: str, keys: str) -> str:
    """CTEs that end in ``unsigned``: keys, body. From the last line up, contact lines go, and after the first of these labels too."""
    contact = f"(regexp_matches(x, '{_CONTACT_SQL}') AND {_sql_count('x', r'\S+')} <= 8)"
    label = rf"(regexp_matches(x, '^[^\-–—*]') AND {_sql_count('x', r'\S+')} BETWEEN 1 AND 6 AND NOT regexp_matches(x, '[.!?]$'))"
    marked = rf"regexp_replace(regexp_replace({x}, '(?m)^--\s?$(?s:.*)', ''), '(?im)^\s*(Sent from my \w+|Get Outlook for \w+|Sent via \w+).*$(?s:.*)', '')"
    return rf"""s1 AS (SELECT {keys}, string_split(regexp_replace({marked}, '\s+$', ''), chr(10)) AS l FROM {source}),
    s2 AS (SELECT *, list_transform(list_reverse(l), lambda y: {_sql_strip("y")}) AS r FROM s1),
    s3 AS (SELECT *, list_transform(r, lambda x: x <> '' AND {contact}) AS c, list_transform(r, lambda x: x <> '' AND ({contact} OR {label})) AS k FROM s2),
    unsigned AS (SELECT {keys}, regexp_replace(array_to_string(l[:len(l) - CASE WHEN c[1] THEN least(len(l), coalesce(nullif(list_position(k, false), 0), len(l) + 1)::bigint) - 1 ELSE 0 END], chr(10)), '\s+$', '') AS body FROM s3)"""


@query(f"WITH {DECORATED}, {_sql_unsigned('decorated', 'raw', 'doc_id')} SELECT doc_id, body FROM unsigned")
def signature_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decorated(spark, sf_dir).select("doc_id", text.without_signature(F.col("raw")).alias("body"))


def _sql_own_html(x: str) -> str:
    """Text of pages without quoted containers: tags are blanks, comments and declarations nothing; the text of scripts and styles stays as it is."""
    bare = r"regexp_replace(regexp_replace({0}, '(?s)<!--.*?-->|<![A-Za-z][^>]*>', '', 'g'), '</?[A-Za-z][^>]*>', ' ', 'g')"
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#x27", "''"), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        bare = f"replace({bare}, '&{name};', '{char}')"
    inner = r"regexp_extract(p, '(?s)^(.*?)</(script|style)\s*>(.*)$', ['data', 'tag', 'rest'])"
    each = f"list_transform(string_split_regex({x}, '<(script|style)[^>]*>'), lambda p, i: CASE WHEN i = 1 THEN {bare.format('p')} ELSE ' ' || {inner}['data'] || ' ' || {bare.format(inner + chr(91) + chr(39) + 'rest' + chr(39) + chr(93))} END)"
    return f"array_to_string({each}, '')"


@query(f"SELECT page_id, {_sql_own_html('html')} AS body FROM pages")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", mail.html_text("html").alias("body"))


# ---- Drafts: a user's turn is a draft, an assistant's turn of the same conversation is what was sent.

_TURNS = """d AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, lower(substr(text, 1, 12)) AS subject, text AS body FROM conversations WHERE role = 'user'),
    s AS (SELECT conv_id * 1000 + turn AS ord, conv_id, turn, lower(substr(text, 1, 12)) AS subject, text AS body FROM conversations WHERE role <> 'user')"""


def _turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    turns = table(spark, sf_dir, "conversations")
    stamp = F.date_format(F.timestamp_seconds(F.col("turn") * 60), "yyyy-MM-dd'T'HH:mm:ss")
    to = F.array(F.concat(F.lit("C"), F.col("conv_id").cast("string"), F.lit("@x.com")))
    rows = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), stamp.alias("stamp"), to.alias("recipients"), F.substring("text", 1, 12).alias("subject"), F.col("text").alias("body"), "role")
    return rows.filter("role = 'user'").withColumnRenamed("stamp", "created"), rows.filter("role <> 'user'").withColumnsRenamed({"id": "ord", "stamp": "date"})


@query(
    f"""WITH {_TURNS}, c AS (SELECT d.id, s.ord, trim(d.subject) = trim(s.subject) AS exact, d.body AS a, s.body AS b FROM d JOIN s ON d.conv_id = s.conv_id AND s.turn >= d.turn),
    j AS (SELECT id, ord, exact, trim(a) <> '' AND trim(b) <> '' AND len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) >= 0.5 AS alike FROM (SELECT *, {_sql_shingles("v")} AS x, {_sql_shingles("w")} AS y FROM (SELECT *, {_sql_tokens("a")} AS v, {_sql_tokens("b")} AS w FROM c))),
    n AS (SELECT id, count(*) AS k FROM j WHERE exact OR alike GROUP BY id)
    SELECT d.id, CASE WHEN k IS NULL THEN 'none' WHEN k = 1 THEN 'matched' ELSE 'ambiguous' END AS status, coalesce(k, 0)::int AS candidates FROM d LEFT JOIN n ON d.id = n.id"""
)
def draft_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, s = _turns(spark, sf_dir)
    return drafts.matches(d, s).select("id", "status", F.size("candidates").alias("candidates"))


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 3 DAY")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created"))
    now = events.agg(F.max("created")).first()[0]
    return drafts.unexpired(events, now, days=3).select("event_id")


@query("SELECT conv_id * 1000 + turn AS id, lower(substr(text, 1, 12)) AS subject FROM conversations WHERE role = 'user' AND turn % 2 = 0")
def pending_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, _ = _turns(spark, sf_dir)
    status = F.when((F.col("id") % 1000) % 2 == 0, "pending").otherwise("matched")
    return drafts.pending(d.withColumn("status", status).withColumn("register", F.lit("client"))).select("id", F.lower("subject").alias("subject"))


# ---- Edits: an event is an observation of its user's draft.

_SIDES = "CASE WHEN event_type IN ('purchase', 'signup') THEN 'reduce' WHEN value < 50 THEN 'reduce' ELSE 'increase' END"


_DIMENSIONS = ", ".join(f"'{d}'" for d in patterns.DIMENSIONS)


@query(
    f"""WITH o AS (SELECT event_id AS ord, user_id::varchar AS draft, CASE event_type WHEN 'click' THEN 'length' WHEN 'purchase' THEN 'hedging' WHEN 'signup' THEN 'opener' WHEN 'error' THEN 'signoff' ELSE event_type END AS dimension, {_SIDES} AS direction FROM events),
    f AS (SELECT dimension, direction, draft, min(ord) AS ord FROM o WHERE dimension IN ({_DIMENSIONS}) GROUP BY 1, 2, 3),
    p AS (SELECT dimension, direction, count(*) AS count, string_agg('e' || ord, ',' ORDER BY ord) AS evidence FROM f GROUP BY 1, 2)
    SELECT dimension, direction, count, evidence FROM p WHERE count >= 2 AND dimension IN (SELECT dimension FROM p GROUP BY dimension HAVING count(*) = 1)"""
)
def promotable(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for pair in (("click", "length"), ("purchase", "hedging"), ("signup", "opener"), ("error", "signoff")) for x in pair])
    kind = F.col("event_type")
    side = F.when(kind.isin("purchase", "signup") | (F.col("value") < 50), "reduce").otherwise("increase")
    evidence = F.concat(F.lit("e"), F.col("event_id").cast("string"))
    observed = F.array(F.struct(F.coalesce(F.try_element_at(kinds, kind), kind).alias("dimension"), side.alias("direction"), evidence.alias("evidence")))
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), F.col("user_id").cast("string").alias("draft_id"), observed.alias("observations"))
    return edits.promotable(log).select("dimension", "direction", "count", F.array_join("evidence", ",").alias("evidence"))


_OBSERVED = """CASE event_type WHEN 'purchase' THEN 'hedging' WHEN 'signup' THEN 'closing_offer' WHEN 'error' THEN 'style' ELSE 'length' END AS dimension,
    CASE event_id % 3 WHEN 0 THEN 'reduce' WHEN 1 THEN 'replace:' || event_type ELSE 'shorten' END AS direction, CASE WHEN value < 10 THEN '' ELSE event_type END AS evidence"""


@query(
    f"""SELECT ord, draft_id FROM (SELECT event_id AS ord, user_id::varchar AS draft_id, {_OBSERVED} FROM events)
    WHERE dimension IN ({_DIMENSIONS}) AND (direction IN ('reduce', 'increase') OR starts_with(direction, 'replace:')) AND evidence <> '' AND draft_id <> ''"""
)
def recorded_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the edit log that validation lets through: known dimension and direction, and evidence."""
    kind = F.col("event_type")
    dimension = F.when(kind == "purchase", "hedging").when(kind == "signup", "closing_offer").when(kind == "error", "style").otherwise("length")
    third = F.col("event_id") % 3
    direction = F.when(third == 0, F.lit("reduce")).when(third == 1, F.concat(F.lit("replace:"), kind)).otherwise("shorten")
    observed = F.array(F.struct(dimension.alias("dimension"), direction.alias("direction"), F.when(F.col("value") < 10, "").otherwise(kind).alias("evidence")))
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), F.col("user_id").cast("string").alias("draft_id"), observed.alias("observations"))
    return edits.recorded(log).select("ord", "draft_id")


# ---- Evaluation: three parts of the documents are truth, profile and control.

_PART = "['truth', 'profile', 'control'][(doc_id % 3 + 1)::int]"
_LONG = f"""{DECORATED}, u AS (SELECT {_PART} AS side, * FROM decorated), p AS (SELECT * FROM ({_sql_pooled("u", "side", "body")})),
    f AS (UNPIVOT p ON contraction_rate, {", ".join(_PUNCT_SQL)} INTO NAME metric VALUE value),
    cmp AS (SELECT t.metric, abs(t.value - p.value) AS p, abs(t.value - c.value) AS c, t.value AS tv, p.value AS pv FROM f t JOIN f p ON t.metric = p.metric AND t.side = 'truth' AND p.side = 'profile' JOIN f c ON t.metric = c.metric AND c.side = 'control')"""


def _sides(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    side = F.element_at(F.array(F.lit("truth"), F.lit("profile"), F.lit("control")), (F.col("doc_id") % 3 + 1).cast("int"))
    wide = metrics.pooled(decorated(spark, sf_dir).withColumn("side", side), ["side"])
    long = written(wide.unpivot("side", [c for c in wide.columns if c != "side"], "metric", "value"), "sides")
    return {s: long.filter(F.col("side") == s).select("metric", "value") for s in ("truth", "profile", "control")}


@query(f"WITH {_LONG} SELECT metric, tv AS a, pv AS b, p AS delta FROM cmp")
def metric_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = _sides(spark, sf_dir)
    return edits.compared(sides["truth"], sides["profile"])


@query(f"WITH {_LONG} SELECT metric, p AS delta FROM cmp ORDER BY p DESC, metric LIMIT 5")
def largest_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = _sides(spark, sf_dir)
    return edits.largest_gaps(edits.compared(sides["truth"], sides["profile"])).select("metric", "delta")


@query(
    f"""WITH {_LONG} SELECT count(*) AS metrics_compared, count(*) FILTER (WHERE p < c) AS profile_closer, count(*) FILTER (WHERE c < p) AS control_closer, count(*) FILTER (WHERE p = c) AS ties,
    round(count(*) FILTER (WHERE p < c) / nullif(count(*) FILTER (WHERE p <> c), 0), 3) AS share, share >= 0.7 AS pass FROM cmp"""
)
def holdout_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = _sides(spark, sf_dir)
    return edits.verdict(edits.compared(sides["truth"], sides["profile"]), edits.compared(sides["truth"], sides["control"]))


@query(
    """WITH m AS (SELECT lang, unnest([source, source || '.' || lang]) AS metric FROM documents), c AS (SELECT lang, metric, count(*)::double AS value FROM m GROUP BY ALL),
    a AS (SELECT * FROM c WHERE lang = 'de'), b AS (SELECT * FROM c WHERE lang = 'es')
    SELECT coalesce(a.metric, b.metric) AS metric, a.value AS a, b.value AS b FROM a FULL JOIN b ON a.metric = b.metric WHERE (a.value IS NULL) <> (b.value IS NULL)"""
)
def metric_one_sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by source in two languages, and by source and language, which one side lacks always."""
    named = table(spark, sf_dir, "documents").select("lang", F.explode(F.array(F.col("source"), F.concat_ws(".", "source", "lang"))).alias("metric"))
    counts = lambda lang: named.filter(F.col("lang") == lang).groupBy("metric").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return edits.one_sided(counts("de"), counts("es"))


@query(
    f"""WITH {DECORATED}, u AS (SELECT lang AS grp, subject, body FROM decorated UNION ALL SELECT '*', subject, body FROM decorated), {_sql_flat("u", "grp")}
    SELECT f.grp, f.metric, round(f.value, 9) AS value, round(w.value, 9) AS corpus_value, round(f.value - w.value, 9) AS delta FROM flat f JOIN flat w ON f.metric = w.metric AND w.grp = '*' AND f.grp <> '*'"""
)
def register_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scalar metric of each language less that of the corpus."""
    groups = F.array(F.col("lang"), F.lit("*"))
    found = analyze.register_deltas(written(metrics.flat(decorated(spark, sf_dir), ["grp"], groups=groups), "flat"))
    return found.select("grp", "metric", *[F.round(c, 9).alias(c) for c in ("value", "corpus_value", "delta")])


@query(
    f"""WITH {DECORATED}, u AS (SELECT {_PART} AS side, subject, body FROM decorated), {_sql_flat("u", "side")},
    cmp AS (SELECT t.metric, abs(t.value - p.value) AS p, abs(t.value - c.value) AS c FROM flat t JOIN flat p ON t.metric = p.metric AND t.side = 'truth' AND p.side = 'profile' LEFT JOIN flat c ON t.metric = c.metric AND c.side = 'control')
    SELECT count(*) FILTER (WHERE c IS NOT NULL) AS metrics_compared, count(*) FILTER (WHERE p < c) AS profile_closer, count(*) FILTER (WHERE c < p) AS control_closer, count(*) FILTER (WHERE p = c) AS ties,
    round(count(*) FILTER (WHERE p < c) / nullif(count(*) FILTER (WHERE p <> c), 0), 3) AS share, share >= 0.7 AS pass,
    (SELECT string_agg(metric, ',' ORDER BY p DESC, metric) FROM (SELECT metric, p FROM cmp ORDER BY p DESC, metric LIMIT 5)) AS gaps FROM cmp"""
)
def holdout_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole evaluation over every scalar metric, with the names of the five largest gaps."""
    parts = decorated(spark, sf_dir).withColumn("side", F.element_at(F.array(F.lit("truth"), F.lit("profile"), F.lit("control")), (F.col("doc_id") % 3 + 1).cast("int")))
    of = lambda side: parts.filter(F.col("side") == side).select("subject", "body")
    verdict, gaps = analyze.holdout(of("truth"), of("profile"), of("control"))
    named = gaps.agg(F.array_sort(F.collect_list(F.struct((-F.col("delta")).alias("d"), "metric"))).alias("g")).select(F.array_join(F.transform("g", lambda x: x["metric"]), ",").alias("gaps"))
    return verdict.join(named, F.lit(True))


# ---- Mail: every document is a message, from the user or another, to one or two of a few addresses.

USER = "dana@own.com"
SENDERS = ["Dana <dana@own.com>", "DANA@own.com", "Kim <kim@a.com>"]
RECIPIENTS = [["kim@a.com"], ["DANA@own.com"], ["lee@b.com", "kim@A.com"], ["dana@own.com", "kim@a.com"], []]
KINDS = ["text/plain", "text/html", "text/calendar", "multipart/mixed"]
WRAPPED = [("", ""), ("Zoom.us/j/99 ", ""), ("", "\nhttps://x.y/z"), ("", "\nOn Mon, Sam wrote:\n> old"), ("> all quoted ", "")]


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    pick = lambda items, c: F.element_at(F.array(*items), (c % len(items) + 1).cast("int"))
    some = lambda items, c: pick([F.lit(x) for x in items], c)
    rows = table(spark, sf_dir, "documents")
    recipients = pick([F.array(*[F.lit(a) for a in r]).cast("array<string>") for r in RECIPIENTS], F.floor(i / 2))
    # A third of the texts is cut to four words, so that links can make up most of a body.
    body = F.when(i % 3 == 1, F.substring_index("text", " ", 4)).otherwise(F.col("text"))
    body = F.concat(some([a for a, _ in WRAPPED], F.floor(i / 4)), body, some([b for _, b in WRAPPED], F.floor(i / 4)))
    subject = F.concat(some(["Re: ", "", "Out of Office: ", "RE: ", "automatic reply "], F.floor(i / 7)), F.substring("text", 1, 50))
    return rows.select(
        i.alias("ord"), F.when(i % 4 == 0, "").otherwise(i.cast("string")).alias("id"), some(SENDERS, F.floor(i / 9)).alias("sender"), recipients.alias("recipients"), subject.alias("subject"),
        F.lit("2026-08-01").alias("date"), some(KINDS, F.floor(i / 11)).alias("content_type"), (i % 13 == 0).alias("auto"), body.alias("body")
    )


def _sql_list(items: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]::varchar[]"


_TO = f"list_extract([{', '.join(_sql_list(r) for r in RECIPIENTS)}], ((doc_id // 2) % {len(RECIPIENTS)} + 1)::int)"
_MARKERS = " OR ".join(f"contains(lower(body), '{m}')".replace("\n", "'||chr(10)||'") for m in patterns.MACHINE_MARKERS)
_NO_LINKS = r"len(regexp_extract_all(regexp_replace(body, 'https?://\S+|\bwww\.\S+', ' ', 'g'), '\S+'))"
_JUDGED = rf"""msg AS (SELECT doc_id AS ord, CASE WHEN doc_id % 4 = 0 THEN '' ELSE doc_id::varchar END AS id, {_sql_pick(SENDERS, "(doc_id // 9)")} AS sender, {_TO} AS recipients,
      {_sql_pick(["Re: ", "", "Out of Office: ", "RE: ", "automatic reply "], "(doc_id // 7)")} || substr(text, 1, 50) AS subject, {_sql_pick(KINDS, "(doc_id // 11)")} AS content_type, doc_id % 13 = 0 AS auto,
      {_sql_pick([a for a, _ in WRAPPED], "(doc_id // 4)")} || CASE WHEN doc_id % 3 = 1 THEN array_to_string(string_split(text, ' ')[:4], ' ') ELSE text END || {_sql_pick([b for _, b in WRAPPED], "(doc_id // 4)")} AS body FROM documents),
    {_sql_unsigned("msg", _sql_unquoted("body"), "ord")},
    judged AS (SELECT msg.* EXCLUDE (body), msg.body AS whole, {_sql_strip("unsigned.body")} AS own,
      CASE WHEN len(recipients) > 0 AND len(list_filter(recipients, lambda a: lower(a) <> '{USER}')) = 0 THEN 'self_addressed'
        WHEN machine THEN 'machine_generated'
        WHEN NOT contains(lower(sender), '{USER}') OR auto OR starts_with(lower(subject), 'out of office') OR starts_with(lower(subject), 'automatic reply') OR starts_with(content_type, 'text/calendar') OR {_sql_strip("unsigned.body")} = '' THEN 'unusable' END AS reason
      FROM (SELECT *, {_MARKERS} OR (regexp_matches(body, 'https?://\S+|\bwww\.\S+') AND {_NO_LINKS} < 4) AS machine FROM msg) msg JOIN unsigned ON msg.ord = unsigned.ord)"""


@query(f"WITH {DECORATED}, {_JUDGED} SELECT ord, reason AS drop_reason FROM judged")
def drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each message is dropped: to oneself, made by a machine, or unusable; null for those that stay."""
    return mail.judged(_messages(spark, sf_dir), USER).select("ord", "drop_reason")


@query(
    rf"""WITH {DECORATED}, {_JUDGED} SELECT ord, CASE WHEN id <> '' THEN id ELSE substr(subject, 1, 40) END AS id, array_to_string(list_sort(list_distinct(list_transform(recipients, lambda a: lower(string_split(a, '@')[2])))), ',') AS to_domains,
      len(recipients)::int AS recipient_count, md5(own) AS body, starts_with(lower(subject), 're:') AS is_reply, {_sql_count("own", r"\S+")}::int AS word_count, word_count < 15 AS is_terse FROM judged WHERE reason IS NULL"""
)
def normalized_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normal form of the messages that stay."""
    rows = mail.normalized(mail.judged(_messages(spark, sf_dir), USER))
    return rows.select("ord", "id", F.array_join(F.array_sort("to_domains"), ",").alias("to_domains"), "recipient_count", F.md5(F.col("body").cast("binary")).alias("body"), "is_reply", "word_count", "is_terse")


@query(
    rf"""WITH {DECORATED}, {_JUDGED}, n AS (SELECT ord, reason, {_sql_count("own", r"\S+")} < 15 AS terse FROM judged)
    SELECT count(*) AS raw, count(*) FILTER (WHERE reason = 'self_addressed') AS self_addressed, count(*) FILTER (WHERE reason = 'machine_generated') AS machine_generated,
    count(*) FILTER (WHERE reason IS NULL) AS deduped, count(*) FILTER (WHERE reason IS NULL AND NOT terse) AS kept, count(*) FILTER (WHERE reason IS NULL AND terse) AS terse FROM n"""
)
def drop_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of what the rules drop and keep (nothing is deduplicated here; see dedupe_kept)."""
    judged = mail.judged(_messages(spark, sf_dir), USER)
    return mail.drop_counts(judged, mail.normalized(judged))


@query(
    """SELECT '<' || conv_id || '.' || turn || '@own.com>' AS id, CASE WHEN turn % 5 = 4 THEN '' ELSE '2025-04-' || lpad((conv_id % 28 + 1)::varchar, 2, '0') || 'T08:' || lpad((turn % 60)::varchar, 2, '0') || ':00-04:00' END AS date,
    'x' || conv_id % 3 || '.com,y.com' AS to_domains, turn % 2 = 1 AS is_reply, role AS subject, md5(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^From ', '>From ', 'g'), '^\\s+', ''), '\\s+$', '')) AS body FROM conversations"""
)
def mbox_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a message of an mbox, written (with lines like its marks quoted) and read back."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    date = F.when(F.col("turn") % 5 == 4, "whenever").otherwise(F.concat(F.lit("Mon, "), two(F.col("conv_id") % 28 + 1), F.lit(" Apr 2025 08:"), two(F.col("turn") % 60), F.lit(":00 -0400")))
    head = F.concat(
        F.lit("From x Mon Apr 14 08:00:00 2025\nFrom: Dana <dana@own.com>\nTo: A <a@X"), (F.col("conv_id") % 3).cast("string"), F.lit(".com>\nCc: b@y.com, c@Y.com\nSubject: "), F.when(F.col("turn") % 2 == 1, "RE: ").otherwise(""), F.col("role"),
        F.lit("\nDate: "), date, F.lit("\nMessage-ID: <"), F.concat_ws(".", "conv_id", "turn"), F.lit("@own.com>\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"),
    )
    path = scratch_path(spark, "mbox")
    table(spark, sf_dir, "conversations").select(F.concat(head, F.regexp_replace("text", "(?m)^From ", ">From "), F.lit("\n"))).write.text(path)
    rows, subject = mail.read_mbox(spark, path), F.lower("subject")
    return rows.select(
        "id", "date", F.array_join(text.domains(F.col("recipients")), ",").alias("to_domains"), F.startswith(subject, F.lit("re:")).alias("is_reply"),
        F.regexp_replace("subject", "^RE: ", "").alias("subject"), F.md5(text.strip(F.col("body")).cast("binary")).alias("body")
    )


@query("SELECT o_orderpriority AS subject, min(strftime(o_orderdate, '%Y-%m-%d')) AS first, max(strftime(o_orderdate, '%Y-%m-%d')) AS last FROM orders WHERE o_orderkey % 11 <> 0 GROUP BY o_orderpriority")
def date_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last date of each subject; messages without a date don't count."""
    rows = _order_messages(spark, sf_dir).filter("subject <> 'Invoices due'")
    undated = rows.withColumn("date", F.lit(""))
    return metrics.date_range(rows.unionByName(undated), ["subject"])


# ---- Logs.


@query("SELECT event_id AS id, event_type AS kind FROM events")
def appended_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of JSON lines, appended to twice, with broken and other lines between."""
    path, rows = scratch_path(spark, "log"), table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))
    files.append_jsonl(rows.filter("id % 2 = 0"), path)
    spark.createDataFrame([("{broken",), ("",), ("42",), ("[1, 2]",)], "value string").write.mode("append").text(path)
    files.append_jsonl(rows.filter("id % 2 = 1"), path)
    return files.read_jsonl(spark, path, "id bigint, kind string")


@query(
    """WITH d AS (SELECT 'd-19700101-' || substr(sha1(strftime(to_timestamp(turn * 60), '%Y-%m-%dT%H:%M:%S') || '|' || substr(text, 1, 12)), 1, 8) AS id, substr(text, 1, 12) AS subject, text FROM conversations WHERE role = 'user')
    SELECT id, subject, CASE WHEN id = (SELECT min(id) FROM d) THEN 'matched' ELSE 'pending' END AS status, md5(text) AS body FROM d"""
)
def draft_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts recorded in a log, one of which is then marked as matched; the log is written anew."""
    path, (turns, _) = scratch_path(spark, "drafts"), _turns(spark, sf_dir)
    files.append_jsonl(drafts.record(turns.withColumn("register", F.lit("client"))), path)
    schema = "id string, subject string, status string, body string"
    first = files.read_jsonl(spark, path, schema).agg(F.min("id")).first()[0]
    files.rewrite_text(drafts.with_status(spark.read.text(path), first or "", "matched"), path)
    return files.read_jsonl(spark, path, schema).withColumn("body", F.md5(F.col("body").cast("binary")))


# ---- What comparisons see of a text.

_MAILED = ["see https://www.google.com/url?q=https%3A%2F%2Fex.com%2Fa%2Bb%3Fc&sa=D for it", "go to http://plain.com/x\nor https://plain.com/y", "wrapped\nhere\n- one\n- two\n2) three\nfour", "a\n \nb\nc https://google.com/url?q=http://z.io/%C3%A9+1\n* last"]
_REDIRECT = r"https?://(?:www\.)?google\.com/url\?q=([^&\s]+)\S*"


def _sql_comparable(x: str) -> str:
    links = f"list_distinct(regexp_extract_all({x}, '{_REDIRECT}'))"
    target = f"url_decode(replace(regexp_extract(l, '{_REDIRECT}', 1), '+', '%2B'))"
    bare = rf"regexp_replace(list_reduce({links}, lambda t, l: replace(t, l, {target}), {x}), '\bhttps?://', '', 'g')"
    lines = f"list_filter(list_transform(string_split(p, chr(10)), lambda y: {_sql_strip('y')}), lambda y: y <> '')"
    joined = rf"coalesce(list_reduce({lines}, lambda t, y: t || CASE WHEN regexp_matches(y, '^([-*•]|\d+[.)])\s') THEN chr(10) ELSE ' ' END || y), '')"
    return rf"array_to_string(list_transform(string_split_regex({bare}, '\n\s*\n'), lambda p: CASE WHEN len({lines}) = 0 THEN '' ELSE {joined} END), chr(10) || chr(10))"


@query(f"SELECT doc_id, {_sql_comparable('body')} AS body FROM (SELECT doc_id, substr(text, 1, 300) || chr(10) || {_sql_pick(_MAILED, 'doc_id')} AS body FROM documents)")
def comparable_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without what mail programs change: redirects around links, schemes and soft line breaks. Bodies are made of a text's
    beginning and a few lines."""
    added = F.element_at(F.array(*[F.lit(x) for x in _MAILED]), (F.col("doc_id") % len(_MAILED) + 1).cast("int"))
    body = F.concat(F.substring("text", 1, 300), F.lit("\n"), added)
    return table(spark, sf_dir, "documents").select("doc_id", text.for_comparison(body).alias("body"))


@query(
    f"""WITH {DECORATED}, m AS (SELECT *, {_sql_count("body", r"[^ \t\n\r\x0b\x0c]+")} AS wc FROM decorated), g AS (SELECT lang AS l, median(wc) AS med FROM m GROUP BY lang),
    s AS (SELECT lang, doc_id, CASE WHEN regexp_matches(body, '{_ASK_SQL}') THEN 1.0 ELSE 0.0 END::double + CASE WHEN len({_sql_paragraphs("body")}) > 1 THEN 0.3 ELSE 0.0 END::double - abs(wc - med) / CASE WHEN med = 0 THEN 1 ELSE med END AS score FROM m JOIN g ON lang = l),
    k AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id)::int AS rank, doc_id FROM s QUALIFY rank <= 4), {_sql_redacted("body")}
    SELECT lang, rank, k.doc_id, t AS body FROM k JOIN red ON k.doc_id = red.doc_id"""
)
def exemplars_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exemplars of each language, redacted. Their number is the feature."""
    rows = decorated(spark, sf_dir).withColumn("word_count", text.n_blank_words(F.col("body")))
    return registers.exemplars(rows, "lang", "doc_id").select("lang", "rank", "doc_id", text.redacted(F.col("body"), ["Dana"]).alias("body"))


# ---- Count files and draft ids.


@query(
    r"""WITH c AS (SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '\s+')) AS word FROM documents) WHERE word <> '' AND NOT contains(word, chr(9)) GROUP BY word),
    v AS (SELECT lower(word) AS phrase, n, word FROM c WHERE regexp_matches(lower(word), '^[a-z'']+$')), t AS (SELECT * FROM v ORDER BY n DESC, word LIMIT 500)
    SELECT 1 AS n, phrase, n / sum(n) OVER () AS freq FROM t"""
)
def count_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of word counts, the most frequent first, written and read back: valid lines up to the 500th. The limit is the reader's feature."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\\s+")).alias("word")).filter("word <> ''")
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "word")
    path = scratch_path(spark, "counts")
    counts.select(F.concat_ws("\t", "word", F.col("n").cast("string"))).coalesce(1).write.text(path)
    return lexicon.read_counts(spark, path, 1, 500)


@query(
    """SELECT o_orderkey, 'd-' || CASE WHEN o_orderkey % 5 = 0 THEN '00000000' ELSE strftime(o_orderdate, '%Y%m%d') END || '-' ||
    substr(sha1(CASE WHEN o_orderkey % 5 = 0 THEN 'sometime' ELSE strftime(o_orderdate, '%Y-%m-%d') || 'T08:00:00-04:00' END || '|' || o_orderpriority), 1, 8) AS id FROM orders"""
)
def draft_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draft ids of stamps with an offset, and of stamps that can't be read."""
    stamp = F.when(F.col("o_orderkey") % 5 == 0, "sometime").otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T08:00:00-04:00")))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.draft_id(stamp, F.col("o_orderpriority")).alias("id"))


# ---- Diffs of neighbouring turns.


def _turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("draft_body"))
    after = Window.partitionBy("conv_id").orderBy("turn")
    paired = turns.withColumn("sent_body", F.lead("draft_body").over(after)).filter("sent_body is not null")
    return paired.withColumn("draft_subject", F.substring("draft_body", 1, 8)).withColumn("sent_subject", F.substring("sent_body", 1, 8))


@query(
    f"""WITH p AS (SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations), q AS (SELECT *, len(regexp_extract_all(a, '\\S+')) AS n, len(regexp_extract_all(b, '\\S+')) AS m, {_sql_shingles("v")} AS x, {_sql_shingles("w")} AS y FROM (SELECT *, {_sql_tokens("a")} AS v, {_sql_tokens("b")} AS w FROM p WHERE b IS NOT NULL))
    SELECT conv_id, turn, CASE WHEN trim(a) = '' OR trim(b) = '' OR len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) < 0.25 THEN 'rewritten' ELSE 'edited' END AS classification, (m - n)::int AS word_count_delta,
      coalesce((m - n) * 100 / nullif(n, 0), 0.0)::double AS word_count_pct, substr(a, 1, 8) <> substr(b, 1, 8) AS subject_changed, len({_sql_sentences("a")})::int AS draft_sentences, len({_sql_paragraphs("b")})::int AS sent_paragraphs FROM q"""
)
def structural_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.structural(_turn_pairs(spark, sf_dir)).select("conv_id", "turn", "classification", "word_count_delta", "word_count_pct", "subject_changed", "draft_sentences", "sent_paragraphs")


@query()
def sentence_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = _turn_pairs(spark, sf_dir).select("conv_id", "turn", diff.sentence_diff(F.col("draft_body"), F.col("sent_body")).alias("c"))
    return changes.select("conv_id", "turn", "c.removed", "c.added", "c.changed")

