"""Information-theoretic sanitisation of personal data; DataFrame functions only.

Protected entities: e-mail addresses, IP addresses, payment-card numbers and telephone numbers by pattern and check
(the base kinds), and secrets, key-like runs of letters and digits. An entity is protected as a value and as one of
its kind. Corpus co-occurrence estimates how strongly a word gives it away: for a word t and an entity e, n(t, e)
texts have both near each other, n(t) the word and n(e) the entity. The share of the entity's self-information that
the word discloses is log(P(e|t) / P(e)) / log(1 / P(e)). Words at or above a threshold are spans of kind ``term``:
they are removed like the entity itself, or generalised (a word with digits becomes ``[code]``, a capitalised one ``[name]``).

Evidence is counted over different texts. Near copies of a text are different, but say no more than the text: so the
texts with word and entity must also fall into several groups by the two smallest hashes of their shingles, which near
copies mostly have in common, and not into few for their number.

Positions come from the gaps and the matches of one pattern, both in order, so that they are code points and need
no user function. Patterns use possessive repetition and start only where a match can start, so long runs of
letters, digits or blanks take linear time. Words of all texts are read once, and only those that stand near an entity
often enough are kept. Pairs of entity and word are counted before they are joined, so that an entity in a third of
all texts is a few partial counts to a task. Lists that steer a pass are broadcast only up to a measured number of
bytes; beyond it the same joins shuffle.

Edge cases: a null text counts as empty and has no spans (sha256 of the empty string); repeated rows get the same
spans each, and count once in the statistics; overlapping spans of different kinds are all reported; an empty
table gives an empty result; a null doc_id is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, fields_for, hinted

_LOCAL, _LABEL = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
#: Java patterns with the same leftmost matches as the plain ones in the README, without their backtracking.
#: ``\G`` lets a match start right behind the previous one, in the middle of a run. Shorter digit runs than a card's
#: are left out at once: a run of digits is maximal, so they could only have failed.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,}+",
    "phone": r"\+[0-9][ ().0-9-]+(?<=[0-9])",
    "secret": r"[A-Za-z0-9_+=]{20,}+",
}
#: What a text must contain to be searched at all.
NEEDS = {"email": "contains({}, '@')", "ip": "contains({}, '.')", "card": "{} rlike '[0-9][ -]?[0-9][ -]?[0-9]'", "phone": "contains({}, '+')", "secret": "{} rlike '[A-Za-z0-9_+=]{{20}}'"}
KINDS = tuple(PATTERNS)
BASE = KINDS[:4]
_SPAN = "array<struct<s:int,e:int,v:string>>"
_BLOCK = 512
#: Context on either side of an entity in code points, texts that must show a word near it, share of the entity's
#: information that a word may disclose, texts to a group of near copies at most.
CONTEXT, SUPPORT, DISCLOSURE, COPIES = 60, 5, 0.9, 3
SHINGLE = 5
_PUNCT = r"^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+\\z"
_CUT = r"^[^ \\t-\\r]+|[^ \\t-\\r]+\\z"


def _spans(text: str, pattern: str) -> str:
    """SQL: array of (start, end, match) of all matches of ``pattern`` (SQL) in ``text`` (SQL)."""
    step = "struct(acc.at + length(p.g[i]) + length(p.m[i]) as at, concat(acc.out, array(struct(cast(acc.at + length(p.g[i]) as int) as s, cast(acc.at + length(p.g[i]) + length(p.m[i]) as int) as e, p.m[i] as v))) as out)"
    block = f"aggregate(sequence(b * {_BLOCK}, least(size(p.m), (b + 1) * {_BLOCK}) - 1), struct(done.at as at, cast(array() as {_SPAN}) as out), (acc, i) -> {step})"
    blocks = f"aggregate(sequence(0, (size(p.m) - 1) div {_BLOCK}), struct(0 as at, cast(array() as array<{_SPAN}>) as all), (done, b) -> transform(array({block}), x -> struct(x.at as at, concat(done.all, array(x.out)) as all))[0]).all"
    both = f"array(struct(split({text}, {pattern}, -1) as g, regexp_extract_all({text}, {pattern}, 0) as m))"
    return f"transform({both}, p -> case when size(p.m) = 0 then cast(array() as {_SPAN}) else flatten({blocks}) end)[0]"


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def base_spans(text: str = "text") -> dict[str, Column]:
    """kind -> column of its valid spans in the SQL expression ``text`` (not null)."""
    digits = "regexp_replace(x.v, '[^0-9]', '')"
    valid = {
        "email": "true",
        "ip": "forall(split(x.v, '[.]'), q -> length(ltrim('0', q)) <= 3 and coalesce(cast(nullif(substring(ltrim('0', q), 1, 4), '') as int), 0) <= 255)",
        "card": f"length({digits}) between 13 and 19 and luhn_check({digits})",
        "phone": f"length({digits}) between 9 and 15",
        # letters and digits by turns, as in keys and unlike in words or numbers
        "secret": "size(regexp_extract_all(x.v, '[0-9]+', 0)) >= 3 and size(regexp_extract_all(x.v, '[A-Za-z]+', 0)) >= 3",
    }
    out = {}
    for kind, pattern in PATTERNS.items():
        found = f"filter({_spans(text, _literal(pattern))}, x -> {valid[kind]})"
        out[kind] = F.expr(f"case when {NEEDS[kind].format(text)} then {found} else cast(array() as {_SPAN}) end")
    return out


def with_base_spans(docs: DataFrame) -> DataFrame:
    """All columns, and __text (null: empty), __rid (the same for equal rows) and __<kind>, the spans of each kind."""
    rows = docs.withColumn("__text", F.coalesce("text", F.lit(""))).withColumn("__rid", F.xxhash64("doc_id", "__text"))
    return rows.withColumns({f"__{k}": c for k, c in base_spans("__text").items()})


def _clean_words(sql: str) -> str:
    """SQL: lower-case words of a text without punctuation at either end."""
    return f"transform(split({sql}, '[ \\\\t-\\\\r]+'), w -> regexp_replace(lower(w), '{_PUNCT}', ''))"


def _near_words(rows: DataFrame, context: int) -> DataFrame:
    """rid (the text), kind, value, words (near it), g (two smallest hashes of the text's shingles) of all entities."""
    tagged = F.expr("concat(" + ", ".join(f"transform(__{k}, x -> struct('{k}' as kind, lower(x.v) as value, x.s as s, x.e as e))" for k in KINDS) + ")")
    found = rows.where(" or ".join(f"size(__{k}) > 0" for k in KINDS)).select(F.xxhash64("__text").alias("rid"), F.col("__text").alias("text"), tagged.alias("x"))
    words = found.withColumn("w", F.expr("filter(split(text, '[ \\\\t-\\\\r]+'), w -> w <> '')"))
    hashed = words.withColumn("h", F.expr(f"transform(sequence(1, greatest(size(w) - {SHINGLE - 1}, 1)), i -> md5(array_join(slice(w, i, {SHINGLE}), ' ')))")).drop("w")
    grouped = hashed.select("rid", "text", "x", F.expr("concat(array_min(h), array_min(transform(h, y -> substring(y, 17))))").alias("g"))
    each = grouped.select("rid", "text", "g", F.explode("x").alias("x")).select("rid", "text", "g", "x.*")
    # the words that are cut by the edge of the context, or touch the entity, are left out
    before = _clean_words(f"regexp_replace(substring(text, greatest(s - {context}, 0) + 1, s - greatest(s - {context}, 0)), '{_CUT}', '')")
    after = _clean_words(f"regexp_replace(substring(text, e + 1, {context}), '{_CUT}', '')")
    return each.select("rid", "kind", "value", "g", F.expr(f"array_distinct(filter(concat({before}, {after}), w -> w <> ''))").alias("words"))


def _evidence(source: DataFrame, context: int, support: int, disclosure: float, copies: int) -> tuple[DataFrame, DataFrame]:
    """(terms with their entities and shares, the occurrences of possible terms as row, rid, term)."""
    near = checkpoint(_near_words(with_base_spans(source), context))
    of = {"value": F.concat_ws(":", "kind", "value"), "kind": F.col("kind")}
    both = [near.select("rid", e.alias("entity"), "g", "words") for e in of.values()]
    told = both[0].unionByName(both[1])
    total = source.where("text is not null").select(F.xxhash64("text")).distinct().count()
    n_entity = told.groupBy("entity").agg(F.count_distinct("rid").alias("n_entity")).where(F.col("n_entity") >= support)
    n_near = near.select("rid", F.explode("words").alias("term")).groupBy("term").agg(F.count_distinct("rid").alias("n_near"))
    n_both = told.select("rid", "entity", "g", F.explode("words").alias("term")).groupBy("entity", "term").agg(
        F.count_distinct("rid").alias("n_both"), F.count_distinct("g").alias("apart")
    ).where((F.col("n_both") >= support) & (F.col("apart") >= support) & (F.col("apart") * copies >= F.col("n_both")))
    # a word near entities in more texts than its share allows is out at once: it stands in no fewer
    reach = F.col("n_both") * F.pow(F.lit(float(total)) / F.col("n_entity"), F.lit(1 - disclosure)) + 0.001
    pairs = n_both.join(n_entity.hint("merge"), "entity").join(n_near.hint("merge"), "term").where(F.col("n_near") <= reach)
    pairs = checkpoint(pairs.select("entity", "term", "n_entity", "n_both"))
    wanted = checkpoint(pairs.select("term").distinct())
    words = source.where("text is not null").select(F.xxhash64("doc_id", "text").alias("row"), F.xxhash64("text").alias("rid"), F.explode(F.expr(f"array_distinct({_clean_words('text')})")).alias("term"))
    hits = checkpoint(words.join(hinted(wanted), "term", "left_semi").select("row", "rid", "term"))
    n_term = hits.groupBy("term").agg(F.count_distinct("rid").alias("n_term"))
    scored = pairs.join(n_term.hint("merge"), "term").withColumn("n_docs", F.lit(total))
    share = F.when(F.col("n_entity") >= total, 0.0).otherwise(F.log(F.col("n_both") * total / (F.col("n_term") * F.col("n_entity"))) / F.log(total / F.col("n_entity")))
    return scored.withColumn("share", share).where(F.col("share") >= disclosure), hits


def disclosing_terms(docs: DataFrame, context: int = CONTEXT, support: int = SUPPORT, disclosure: float = DISCLOSURE, copies: int = COPIES) -> DataFrame:
    """term, entity (kind:value, or the kind alone), n_both, n_term, n_entity, n_docs, share (of the entity's information).

    Evidence is counted over different texts, of which it needs ``support``, in as many groups by shingles and in one for
    every ``copies`` texts at least.
    """
    return _evidence(fields_for(docs, "doc_id", "text"), context, support, disclosure, copies)[0]


def personal_data(docs: DataFrame, context: int = CONTEXT, support: int = SUPPORT, disclosure: float = DISCLOSURE, copies: int = COPIES) -> DataFrame:
    """All columns, and __text, __email, __ip, __card, __phone, __secret and __term (arrays of start, end, value)."""
    terms, hits = _evidence(fields_for(docs, "doc_id", "text"), context, support, disclosure, copies)
    told = checkpoint(terms.select("term").distinct())
    by_row = checkpoint(hits.join(hinted(told), "term").groupBy(F.col("row").alias("__rid")).agg(F.collect_set("term").alias("__terms")))
    rows = with_base_spans(docs).join(hinted(by_row), "__rid", "left")
    # the word without punctuation at either end
    clean = f"regexp_replace(lower(x.v), '{_PUNCT}', '')"
    left, right = _PUNCT.split("|")
    whole = "struct(cast(x.s + length(x.v) - length(regexp_replace(x.v, '{0}', '')) as int) as s, cast(x.e - length(x.v) + length(regexp_replace(x.v, '{1}', '')) as int) as e, regexp_replace(x.v, '{2}', '') as v)".format(left, right, _PUNCT)
    every = _spans("__text", "'[^ \\\\t-\\\\r]+'")
    term = F.expr(f"case when __terms is null then cast(array() as {_SPAN}) else transform(filter({every}, x -> array_contains(__terms, {clean})), x -> {whole}) end")
    return rows.withColumn("__term", term).drop("__rid", "__terms")


def joined_spans(*kinds: str) -> Column:
    """``kind:start:end`` of the kinds in their order, comma-joined."""
    parts = ", ".join(f"transform(__{k}, x -> concat_ws(':', '{k}', x.s, x.e))" for k in kinds)
    return F.expr(f"array_join(concat({parts}), ',')")


def privacy_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_term."""
    found = personal_data(fields_for(docs, "doc_id", "text"), **options)
    counts = [F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in (*KINDS, "term")]
    return found.select("doc_id", *counts[:4], F.sha2(joined_spans(*BASE), 256).alias("base_sha256"), joined_spans(*KINDS, "term").alias("spans"), *counts[4:])


def sanitised(docs: DataFrame, **options) -> DataFrame:
    """The rows with all their columns; in text every span is replaced, entities by their kind, terms by what they are
    in general. A null text stays null; a column n_chars is set to the new length."""
    found = personal_data(docs, **options)
    name = "case when x.v rlike '[0-9]' then '[code]' when substring(x.v, 1, 1) <> lower(substring(x.v, 1, 1)) then '[name]' else '' end"
    marks = [f"transform(__{k}, x -> struct(x.s as s, x.e as e, '[{k}]' as r))" for k in KINDS]
    every = F.expr(f"array_sort(concat({', '.join(marks)}, transform(__term, x -> struct(x.s as s, x.e as e, {name} as r))))")
    # one pass from the left; of overlapping spans the one that starts first stands, and the rest of the other goes too
    step = "case when x.s >= acc.at then struct(x.e as at, concat(acc.out, array(substring(__text, acc.at + 1, x.s - acc.at), x.r)) as out) else struct(greatest(acc.at, x.e) as at, acc.out as out) end"
    put = f"aggregate(__every, struct(0 as at, cast(array() as array<string>) as out), (acc, x) -> {step}, acc -> concat(array_join(acc.out, ''), substring(__text, acc.at + 1)))"
    clean = F.when(F.size("__every") == 0, F.col("text")).otherwise(F.expr(put))
    out = found.withColumn("__every", every).withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(docs.columns)
