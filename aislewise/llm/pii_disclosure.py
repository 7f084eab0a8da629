"""Personal data and information-theoretic sanitisation, in DataFrame functions only.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers by fixed patterns. The
values of these spans are the protected entities. A term (a word: a run of letters and digits, however
short) discloses an entity if seeing it tells, with much certainty, which entity the document holds. Of
all ``rows`` documents ``df`` hold the term anywhere, ``around`` hold the entity, and ``joint`` hold
both, however far apart. The term is disclosing if

- at least ``min_different`` of the texts that hold both differ: not a single text and its copies;
- ``joint / df >= min_share``: the probability of the entity, given the term;
- ``log2(joint * rows / (df * around)) >= min_bits``: their pointwise mutual information.

All other occurrences of such terms would give the entity away even where it is masked, so each is
a span of kind ``term``, to be removed like the rest.

Spans count code points, the end is exclusive. How the positions are found natively: ``split`` gives
what stands between the matches and ``regexp_extract_all`` the matches, so that running sums of their
lengths are the positions. The patterns are written with possessive loops and begin where a run
begins (or where the match before ended), which gives the same leftmost matches as the plain
patterns but neither recursion nor repeated scans on long runs.

Defined cases: a null or empty text has no spans; very long texts take time in proportion to their words
and spans; at equal begins the kinds' order decides; rows are judged by their texts, so repeated rows
give equal results; null ids are kept; extra columns are ignored; empty
input gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislewise.llm.common import maybe_in, written

_LOCAL = "[A-Za-z0-9._%+-]"
#: Kinds in order, and their patterns.
KINDS: dict[str, str] = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this holds no span of the kind.
_NEEDS: dict[str, str] = {
    "email": "contains(text, '@')",
    "ip": r"text rlike '[0-9][.][0-9]'",
    "card": r"text rlike '[0-9](?:[ -]?[0-9]){15}'",
    "phone": r"contains(text, '+')",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Which matches count, as conditions on a match ``m``.
_VALID: dict[str, str] = {
    "email": "true",
    "ip": rf"m rlike '^{_BYTE}(?:[.]{_BYTE}){{3}}$'",
    "card": """length(regexp_replace(m, '[ -]', '')) BETWEEN 16 AND 19 AND aggregate(
        transform(split(reverse(regexp_replace(m, '[ -]', '')), ''), (d, i) -> if(d = '', 0, if(i % 2 = 0, int(d), if(int(d) > 4, 2 * int(d) - 9, 2 * int(d))))),
        0, (a, x) -> a + x) % 10 = 0""",
    "phone": "length(regexp_replace(m, '[^0-9]', '')) BETWEEN 8 AND 15",
}
_SPAN = "struct<kind:string,begin:int,end:int,value:string>"
_GROUP = 256
TERM = r"[\p{L}\p{N}]++"


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _pairs(pattern: str, column: str = "text") -> str:
    """SQL for all matches of a pattern (an SQL expression) in order: what was skipped before each, its
    length and itself. One pass to split and one to extract."""
    both = f"zip_with(split({column}, {pattern}, -1), regexp_extract_all({column}, {pattern}, 0), (a, b) -> named_struct('skip', length(a), 'n', length(b), 'm', b))"
    return f"filter({both}, x -> x.m IS NOT NULL)"


def _groups(column: str) -> str:
    """SQL for an array column in groups. The column is named twice, so that the optimizer leaves it in a
    projection of its own and does not compute it again for each group."""
    return f"transform(sequence(0, greatest(size({column}) - 1, 0) div {_GROUP}), g -> slice({column}, g * {_GROUP} + 1, {_GROUP}))"


def _positions(pairs: str, kind: str) -> str:
    """SQL for a column of pairs as spans. Running sums go over groups of matches, so that no long
    array is copied for each match."""
    empty = f"cast(array() AS array<{_SPAN}>)"
    inner = f"""aggregate(g, named_struct('at', a.at, 'out', {empty}),
        (s, x) -> named_struct('at', s.at + x.skip + x.n, 'out', concat(s.out, array(named_struct('kind', '{kind}', 'begin', s.at + x.skip, 'end', s.at + x.skip + x.n, 'value', x.m)))),
        s -> named_struct('at', s.at, 'out', concat(a.out, array(s.out))))"""
    return f"aggregate({_groups(pairs)}, named_struct('at', 0, 'out', cast(array() AS array<array<{_SPAN}>>)), (a, g) -> {inner}, a -> flatten(a.out))"


def with_spans(df: DataFrame, name: str = "spans") -> DataFrame:
    """``df`` (with a column ``text`` without nulls) and its valid spans by kind, then begin."""
    none = "cast(array() AS array<struct<skip:int,n:int,m:string>>)"
    matches = [F.expr(f"if({_NEEDS[k]}, {_pairs(_sql(KINDS[k]))}, {none})").alias(f"pairs_{k}") for k in KINDS]
    parts = [f"filter({_positions(f'pairs_{k}', k)}, s -> {_VALID[k].replace('m rlike', 's.value rlike').replace('(m,', '(s.value,')})" for k in KINDS]
    return df.select("*", *matches).withColumn(name, F.expr(f"concat({', '.join(parts)})")).drop(*[f"pairs_{k}" for k in KINDS])


def _joined(spans: str) -> str:
    return f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.begin, s.end)), ',')"


def _terms(text: str) -> str:
    return f"array_distinct(regexp_extract_all(lower({text}), {_sql(TERM)}, 0))"


def find_spans(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``text_key`` (a digest of the text), base ``spans`` and ``entities`` (their distinct
    values) of every row. Written once; the texts stay behind."""
    rows = df.select(df[id_col].alias("id"), F.coalesce(df[text_col], F.lit("")).alias("text"))
    rows = with_spans(rows.select("id", "text", F.md5("text").alias("text_key"))).drop("text")
    entities = F.expr("array_distinct(transform(spans, s -> concat(s.kind, ':', lower(s.value))))")
    return written(rows.withColumn("entities", entities), "spans")


def disclosing_terms(df: DataFrame, spans: DataFrame, text_col: str, min_different: int = 2, min_share: float = 0.5, min_bits: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """The terms that disclose an entity (``term``), and which texts hold them (``term``, ``text_key``).
    Every count is aggregated before it is shuffled.

    Exact bounds keep the counts small. ``joint <= df``, so an entity in more than ``rows / 2**min_bits``
    documents has no disclosing term. ``near``, the rows with the term among those with any entity that
    is left, is at most ``df``, and ``joint`` at most ``around``, so terms that stand in too many of
    those for any of the entities are left out before pairs are made, and ``near`` in the place of ``df``
    rules out most pairs; only what is left is counted over all texts."""
    rows = spans.count()
    slack = 1e-9  # of the logarithms, so that bounds never cut what the last test would keep
    none = spans.sparkSession.createDataFrame([], "term string, text_key string")
    if not rows:
        return none.select("term"), none
    one = spans.where("size(entities) > 0").groupBy("text_key").agg(F.first("entities").alias("entities"), F.count("*").alias("n"))
    held = written(one.select("text_key", "n", F.explode("entities").alias("entity")), "entities")
    many = held.groupBy("entity").agg(F.count("*").alias("different"), F.sum("n").alias("around"))
    many = written(many.where((F.col("different") >= min_different) & (F.log2(rows / F.col("around")) >= min_bits - slack)).drop("different"), "many")
    most = many.agg(F.max("around")).first()[0]
    if most is None:
        return none.select("term"), none
    shared = held.join(many, "entity").groupBy("text_key", "n").agg(F.collect_list(F.struct("entity", "around")).alias("entities"))  # entities of one text
    shared = written(shared, "shared")
    texts = df.select(F.coalesce(df[text_col], F.lit("")).alias("text")).withColumn("text_key", F.md5("text"))
    some = maybe_in(texts, "text_key", shared.select("text_key")).where("maybe").select("text", "text_key").dropDuplicates(["text_key"])
    some = written(some.join(shared, "text_key").select("text_key", "n", "entities", F.expr(_terms("text")).alias("terms")), "shared-terms")
    near = some.select("n", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("texts"), F.sum("n").alias("near"))
    near = written(near.where((F.col("texts") >= min_different) & (F.col("near") * min_share <= most) & (F.log2(rows / F.col("near")) >= min_bits - slack)).drop("texts"), "near")
    rare = maybe_in(some.select("n", "entities", F.explode("terms").alias("term")), "term", near.select("term")).where("maybe")
    pairs = rare.select("n", "term", F.explode("entities").alias("e")).groupBy("term", "e.entity", "e.around").agg(F.count("*").alias("different"), F.sum("n").alias("joint"))
    joint = pairs.where(F.col("different") >= min_different).join(near, "term")
    bits = lambda df: F.log2(F.col("joint") * F.lit(rows) / (F.col(df) * F.col("around")))
    joint = written(joint.where((F.col("joint") >= min_share * F.col("near")) & (bits("near") >= min_bits - slack)).select("term", "around", "joint"), "joint")
    words = texts.select("text_key", F.explode(F.expr(_terms("text"))).alias("term"))
    hits = written(maybe_in(words, "term", joint.select("term")).where("maybe").select("term", "text_key"), "hits")
    counts = hits.groupBy("term").agg(F.count("*").alias("df"))
    chosen = joint.join(counts, "term").where((F.col("joint") >= min_share * F.col("df")) & (bits("df") >= min_bits))
    chosen = written(chosen.select("term").distinct(), "terms")
    holds = maybe_in(hits, "term", chosen).where("maybe").select("term", "text_key").distinct().join(chosen, "term", "left_semi")
    return chosen, written(holds, "holds")


def term_spans(df: DataFrame, text_col: str, holds: DataFrame) -> DataFrame:
    """``text_key`` and ``terms`` (spans of kind ``term``) of every text with a disclosing term. Texts that
    a bit map of digests finds give their words where they are, in groups that know the place of their first;
    only words that a bit map of terms finds get a place and are shuffled, and of copies once."""
    texts = df.select(F.coalesce(df[text_col], F.lit("")).alias("text")).withColumn("text_key", F.md5("text"))
    some = maybe_in(texts, "text_key", holds.select("text_key").distinct()).where("maybe")
    pattern = _sql(TERM)
    some = some.select("text_key", F.expr(f"regexp_extract_all(text, {pattern}, 0) AS words"), F.expr(f"split(text, {pattern}, -1) AS skips"))
    numbers = f"sequence(0, greatest(size(words) - 1, 0) div {_GROUP})"
    some = some.select("text_key", F.expr(f"transform({numbers}, g -> named_struct('w', slice(words, g * {_GROUP} + 1, {_GROUP}), 's', slice(skips, g * {_GROUP} + 1, {_GROUP}))) AS parts"))
    sums = "aggregate(transform(parts, p -> length(array_join(p.w, '')) + length(array_join(p.s, ''))), named_struct('at', 0, 'out', cast(array() AS array<int>)), (a, n) -> named_struct('at', a.at + n, 'out', concat(a.out, array(a.at))), a -> a.out)"
    groups = some.withColumn("begins", F.expr(sums)).select("text_key", F.expr("inline(arrays_zip(parts, begins))"))
    words = groups.select("text_key", F.col("begins").alias("at"), F.col("parts.w").alias("w"), F.col("parts.s").alias("s")).select("text_key", "at", "w", "s", F.expr("posexplode(w) AS (i, value)"))
    rare = maybe_in(words.withColumn("term", F.lower("value")), "term", holds.select("term").distinct()).where("maybe")
    begin = F.expr("at + length(array_join(slice(s, 1, i + 1), '')) + length(array_join(slice(w, 1, i), ''))")
    rare = rare.select("text_key", "term", "value", begin.alias("begin")).dropDuplicates(["text_key", "begin"])
    kept = rare.join(holds, ["text_key", "term"], "left_semi").withColumn("end", F.expr("begin + length(value)"))
    terms = F.expr("array_sort(collect_list(named_struct('kind', 'term', 'begin', begin, 'end', end, 'value', value)))")  # of one text
    return written(kept.groupBy("text_key").agg(terms.alias("terms")), "term-spans")


_APART = "filter(terms, t -> NOT exists(spans, b -> t.begin < b.end AND b.begin < t.end))"


def personal_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """One row per input row: ``id``, numbers of base spans ``n_email``, ``n_ip``, ``n_card``,
    ``n_phone``, ``base`` and ``spans`` (all spans) as ``kind:begin:end`` by kind, then begin,
    joined by commas."""
    found = find_spans(df, id_col, text_col)
    _, holds = disclosing_terms(df, found, text_col, **thresholds)
    terms = term_spans(df, text_col, holds)
    rows = found.drop("entities").join(terms, "text_key", "left")
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) AS long)").alias(f"n_{k}") for k in KINDS]
    everything = F.expr(_joined(f"if(terms IS NULL, spans, concat(spans, {_APART}))"))
    return rows.select("id", *counts, F.expr(_joined("spans")).alias("base"), everything.alias("spans"))


def sanitise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """``df`` with each span of its texts replaced by its kind, as ``[EMAIL]`` or ``[TERM]``; spans that
    overlap are replaced as one. All other columns stay as they are, and null texts null."""
    found = find_spans(df, id_col, text_col)
    _, holds = disclosing_terms(df, found, text_col, **thresholds)
    terms = term_spans(df, text_col, holds)
    names = df.columns
    rows = df.toDF(*[f"in_{i}" for i in range(len(names))])
    text = f"in_{names.index(text_col)}"
    rows = rows.withColumn("text", F.coalesce(F.col(text), F.lit(""))).withColumn("text_key", F.md5("text"))
    marked = maybe_in(rows, "text_key", terms.select("text_key"))
    plain = marked.where("NOT maybe").withColumn("terms", F.expr(f"cast(NULL AS array<{_SPAN}>)"))
    other = marked.where("maybe").join(terms, "text_key", "left")
    rows = with_spans(plain.unionByName(other))
    cut = "array<struct<b:int,e:int,k:string>>"
    rows = rows.withColumn("cuts", F.expr(f"array_sort(transform(if(terms IS NULL, spans, concat(spans, {_APART})), s -> named_struct('b', s.begin, 'e', s.end, 'k', s.kind)))"))
    # Overlapping cuts become one; in groups, so that no long array is copied for each cut.
    step = f"""aggregate(g, named_struct('last', a.last, 'done', cast(array() AS {cut})),
        (s, x) -> if(s.last IS NOT NULL AND x.b < s.last.e, named_struct('last', named_struct('b', s.last.b, 'e', greatest(s.last.e, x.e), 'k', s.last.k), 'done', s.done),
            named_struct('last', x, 'done', if(s.last IS NULL, s.done, concat(s.done, array(s.last))))),
        s -> named_struct('last', s.last, 'out', concat(a.out, array(s.done))))"""
    merged = f"aggregate({_groups('cuts')}, named_struct('last', cast(NULL AS struct<b:int,e:int,k:string>), 'out', cast(array() AS array<{cut}>)), (a, g) -> {step}, a -> concat(flatten(a.out), if(a.last IS NULL, cast(array() AS {cut}), array(a.last))))"
    rows = rows.withColumn("cuts", F.expr(f"if(size(cuts) < 2, cuts, {merged})"))
    # A group's stretch of text is taken out once, and its pieces from the stretch.
    piece = "concat(substring(h.t, if(i = 0, 0, g[greatest(i - 1, 0)].e - h.o) + 1, s.b - if(i = 0, h.o, g[greatest(i - 1, 0)].e)), '[', upper(s.k), ']')"
    held = "array(named_struct('t', substring(text, a.at + 1, element_at(g, -1).e - a.at), 'o', a.at))"
    stretch = f"named_struct('at', element_at(g, -1).e, 'out', concat(a.out, transform({held}, h -> array_join(transform(g, (s, i) -> {piece}), ''))))"
    pieces = f"aggregate({_groups('cuts')}, named_struct('at', 0, 'out', cast(array() AS array<string>)), (a, g) -> {stretch}, a -> concat(array_join(a.out, ''), substring(text, a.at + 1)))"
    clean = F.expr(f"if(size(cuts) = 0, {text}, {pieces})")
    return rows.withColumn(text, clean).select(*[F.col(f"in_{i}").alias(n) for i, n in enumerate(names)])
