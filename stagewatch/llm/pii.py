"""Personal data: direct identifiers, and terms that disclose them.

Identifiers (emails, ip addresses, card and phone numbers) are found by patterns. The
terms around them are judged by what the corpus says: with N documents, the information
content of an identifier e is IC(e) = log2(N / df(e)), and a term t tells
PMI(t; e) = log2(N co(t, e) / (df(t) df(e))) bits of it, where co counts the documents that
have both t and e. Their ratio is the disclosure of e by t: 1 means that whoever sees t can
name e. Terms from ``GENERALISE`` on are replaced by a general word, from ``REMOVE`` on
removed, wherever they stand in a text that has an identifier; they are found in all texts on request. A term must have been seen
with e in ``SUPPORT`` different contexts (``WINDOW`` characters on both sides of e: those that
hold t, or one of a document where none does): copies of one passage are no evidence. An identifier that stands in every
document has an information content of 0: nothing discloses it.

Only DataFrame and SQL functions are used. The patterns are written so that a match is
tried once per run of characters and never backtracks into one.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import any_of, stored

WINDOW = 60
SUPPORT = 2
#: How many places of an array are folded at once.
CHUNK = 256
#: How many code points of a text stand in one block when it is put together anew.
BLOCK = 1024
GENERALISE, REMOVE = 0.8, 0.95

#: The kinds in the order in which they are listed, and their patterns. ``\G`` and the
#: look-behind only spare starts inside a run whose first start has failed already. A card is a whole
#: run of digits, single blanks and hyphens; runs of another number of digits fail anyway.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_TERM = r"[\p{L}\p{N}]+"
SPAN = "struct<kind:string,start:int,end:int,value:string,before:string,after:string>"


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _running(xs: str, step: str) -> str:
    """Of each place of the int column ``xs``, ``step(so far, x)`` folded over all places before it, from 0, and
    at the end over all of them. An accumulated array is copied at each step, so places go in chunks."""
    parts = f"transform(sequence(0, size({xs}) - 1, {CHUNK}), c -> slice({xs}, c + 1, {CHUNK}))"
    none = "cast(array() as array<int>)"
    heads = (f"aggregate({parts}, struct(0 as v, {none} as o), "
             f"(s, c) -> struct(aggregate(c, s.v, (v, x) -> {step}) as v, concat(s.o, array(s.v)) as o)).o")
    inside = f"aggregate(c, struct(h as v, {none} as o), (s, x) -> struct({step.replace('v', 's.v')} as v, concat(s.o, array(s.v)) as o)).o"
    whole = f"aggregate({xs}, 0, (v, x) -> {step})"
    return f"if({xs} is null or size({xs}) = 0, array(0), concat(flatten(zip_with({parts}, {heads}, (c, h) -> {inside})), array({whole})))"


def _search(xs: str, field: str, value: str, then: str) -> str:
    """``then`` of ``n``, how many of the column ``xs`` (sorted by ``field``) have a ``field`` below ``value``; by halving."""
    steps = f"transform(sequence(cast(ceil(log2(size({xs}) + 1)) as int), 0, -1), b -> shiftleft(1, b))"
    return f"aggregate({steps}, 0, (n, p) -> if(get({xs}, n + p - 1).{field} < {value}, n + p, n), n -> {then})"


def _with_starts(df: DataFrame, gaps: str, found: str, out: str) -> DataFrame:
    """Add where each of ``found`` starts, in code points; ``gaps`` are the texts between them."""
    lengths = f"{out}_lengths"
    df = df.withColumn(lengths, F.expr(f"flatten(zip_with(slice({gaps}, 1, size({found})), {found}, (a, b) -> array(length(a), length(b))))"))
    return df.withColumn(out, F.expr(f"filter({_running(lengths, 'v + x')}, (x, i) -> i % 2 = 1)")).drop(lengths)


def _valid(kind: str, span: Column) -> Column:
    v = span["value"]
    digits = F.regexp_replace(v, "[^0-9]", "")
    if kind == "ip":
        return v.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$")
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def with_identifiers(df: DataFrame, text: str = "__text", out: str = "__spans") -> DataFrame:
    """Add an array of the identifiers in column ``text``: kind, start and end in code points (end
    exclusive), value, and the text around; by kind as listed, then by start."""
    first = {k: F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0)) for k in KINDS}
    first["email"] = F.when(F.contains(F.col(text), F.lit("@")), first["email"])
    first["phone"] = F.when(F.contains(F.col(text), F.lit("+")), first["phone"])
    none = F.expr("cast(array() as array<string>)")
    df = df.withColumns({f"__m_{k}": F.coalesce(first[k], none) for k in KINDS})
    df = df.withColumns({f"__g_{k}": F.when(F.size(f"__m_{k}") > 0, F.split(text, PATTERNS[k], -1)) for k in KINDS})
    for k in KINDS:
        df = _with_starts(df, f"__g_{k}", f"__m_{k}", f"__s_{k}")
    spans = [F.filter(F.coalesce(F.expr(
        f"transform(__m_{k}, (v, i) -> struct('{k}' as kind, __s_{k}[i] as start, __s_{k}[i] + length(v) as end, v as value, "
        f"right(__g_{k}[i], {WINDOW}) as before, left(__g_{k}[i + 1], {WINDOW}) as after))"),
        F.expr(f"cast(array() as array<{SPAN}>)")), partial(_valid, k)) for k in KINDS]
    return df.withColumn(out, F.concat(*spans)).drop(*[f"__{a}_{k}" for a in "mgs" for k in KINDS])


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """Text (null: empty) and two hashes that name the row; equal rows share their results."""
    text, doc_id = F.coalesce(docs["text"], F.lit("")), docs["doc_id"].cast("long")
    return docs.select(doc_id.alias("__id"), text.alias("__text"), F.xxhash64(doc_id, text).alias("__k1"),
                       F.xxhash64(text, F.lit(1), doc_id).alias("__k2"), *more)


def _terms_around(found: DataFrame) -> DataFrame:
    """A row per identifier, side and term: where the term stands, and a hash of the context."""
    one = found.select("__k1", "__k2", F.explode("__spans").alias("s")).select(
        "__k1", "__k2", "s.kind", "s.value", F.xxhash64("s.before", "s.after").alias("context"),
        F.explode(F.array(
            # a term cut by the window's edge does not count
            F.expr(f"struct(if(length(s.before) < {WINDOW}, s.before, regexp_replace(s.before, {_sql('^' + _TERM)}, '')) as side, s.start as at, true as left)"),
            F.expr(f"struct(if(length(s.after) < {WINDOW}, s.after, regexp_replace(s.after, {_sql(_TERM + '$')}, '')) as side, s.end as at, false as left)"),
        )).alias("x"))
    one = one.select("__k1", "__k2", "kind", "value", "context", F.col("x.side").alias("side"),
                     F.expr("if(x.left, x.at - length(x.side), x.at)").alias("at"))
    one = one.withColumn("m", F.regexp_extract_all("side", F.lit(_TERM), F.lit(0))).where("size(m) > 0")
    one = one.withColumn("g", F.split("side", _TERM, -1))
    one = _with_starts(one, "g", "m", "st")
    return one.select("__k1", "__k2", "kind", "value", "context", "at", F.explode(F.arrays_zip("m", "st")).alias("t")).select(
        "__k1", "__k2", "kind", "value", "context", F.lower("t.m").alias("term"), (F.col("at") + F.col("t.st")).alias("start"),
        (F.col("at") + F.col("t.st") + F.length("t.m")).alias("end")).where(F.col("term").rlike(r"\p{L}"))


def _terms_of(docs: DataFrame) -> Column:
    """The distinct terms of a text, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(docs["__text"]), F.lit(_TERM), F.lit(0)))


def _disclosing(found: DataFrame, docs: DataFrame) -> DataFrame:
    """``kind, value, term, disclosure`` of the terms from ``GENERALISE`` on."""
    around = (_terms_around(found).groupBy("__k1", "__k2", "kind", "value", "term")
              .agg(F.collect_set("context").alias("near")))
    one = found.select("__k1", "__k2", F.explode("__spans").alias("s")).select(
        "__k1", "__k2", "s.kind", "s.value", F.xxhash64("s.before", "s.after").alias("context"))
    supported = (one.groupBy("kind", "value", "context").agg(F.lit(1).alias("one"))
                 .groupBy("kind", "value").agg(F.count("*").alias("all")).where(F.col("all") >= SUPPORT).drop("all"))
    # Texts, as distinct structs are found by comparing all with all.
    named = F.array_distinct(F.transform("__spans", lambda s: F.concat(s["kind"], F.lit(":"), s["value"])))
    of_value = (found.select(F.explode(named).alias("e")).groupBy("e").agg(F.count("*").alias("df_e"))
                .select(F.substring_index("e", ":", 1).alias("kind"), F.expr("substring(e, locate(':', e) + 1)").alias("value"), "df_e")
                .join(supported, ["kind", "value"]))
    total = docs.count()
    of_term = (docs.select(F.explode(_terms_of(docs)).alias("term")).groupBy("term").agg(F.count("*").alias("df_t")))
    values = (one.groupBy("__k1", "__k2", "kind", "value").agg(F.min("context").alias("first")).join(of_value, ["kind", "value"]))
    terms = (found.join(values.select("__k1", "__k2").distinct(), ["__k1", "__k2"], "left_semi")
             .select("__k1", "__k2", F.explode(_terms_of(found)).alias("term")).where(F.col("term").rlike(r"\p{L}"))
             .groupBy("__k1", "__k2", "term").agg(F.count("*").alias("copies")).join(of_term, "term"))
    # co is no more than df_e, which bounds the df_t of what can disclose e; the factor is for rounding.
    most = f"df_t <= 1.000001 * df_e * power(cast({total} as double) / df_e, {1 - GENERALISE})"
    both = values.join(terms, ["__k1", "__k2"]).where(F.expr(most)).join(around, ["__k1", "__k2", "kind", "value", "term"], "left")
    # A document counts once, in one of its contexts, however many it has.
    seen = both.select("kind", "value", "term", "df_e", "df_t", "copies",
                       F.posexplode(F.coalesce("near", F.array("first"))).alias("i", "context"))
    pairs = (seen.groupBy("kind", "value", "term", "context").agg(
        F.sum(F.when(F.col("i") == 0, F.col("copies")).otherwise(0)).alias("n"), F.max("df_e").alias("df_e"), F.max("df_t").alias("df_t"))
        .groupBy("kind", "value", "term").agg(F.sum("n").alias("co"), F.count("*").alias("contexts"),
                                              F.max("df_e").alias("df_e"), F.max("df_t").alias("df_t"))
        .where(F.col("contexts") >= SUPPORT))
    judged = pairs.withColumn(
        "disclosure", F.expr(f"if(df_e < {total}, log2(co * cast({total} as double) / (df_t * df_e)) / log2(cast({total} as double) / df_e), null)"))
    return judged.where(F.col("disclosure") >= GENERALISE).select("kind", "value", "term", "disclosure")


def with_terms(docs: DataFrame, found: DataFrame, everywhere: bool = False) -> DataFrame:
    """``found`` (``__k1, __k2, __text, __spans``) with ``__terms``: the spans of the terms that
    disclose any identifier, wherever in the text they stand, by start; null without any. They are looked for
    in the texts that have an identifier, or ``everywhere`` (``found`` then holds all rows)."""
    some = found.where("size(__spans) > 0")
    told = stored(_disclosing(some, docs).groupBy("term").agg(F.max("disclosure").alias("disclosure")), "disclosing")
    looked = docs if everywhere else some
    held = (looked.select("__k1", "__k2", F.explode(_terms_of(looked)).alias("term")).join(told, "term").distinct()
            .groupBy("__k1", "__k2").agg(F.array_sort(F.collect_list(F.struct("term", "disclosure"))).alias("__told")))
    if not everywhere:
        return _placed(found.join(held, ["__k1", "__k2"], "left"))
    # Only texts that hold such a term are needed again, and each once; the identifiers meet what was found in them.
    texts = docs.select("__k1", "__k2", "__text").join(held, ["__k1", "__k2"]).dropDuplicates(["__k1", "__k2"])
    return found.join(_placed(texts).select("__k1", "__k2", "__terms"), ["__k1", "__k2"], "left")


def _placed(out: DataFrame) -> DataFrame:
    """Add ``__terms``: where the terms of ``__told`` (sorted; null without any) stand in ``__text``."""
    out = out.withColumn("__m", F.when(F.col("__told").isNotNull(), F.regexp_extract_all("__text", F.lit(_TERM), F.lit(0))))
    out = out.withColumn("__g", F.when(F.col("__told").isNotNull(), F.split("__text", _TERM, -1)))
    out = _with_starts(out, "__g", "__m", "__st")
    told = _search("__told", "term", "lower(m)", "if(get(__told, n).term = lower(m), get(__told, n).disclosure, null)")
    return out.withColumn("__terms", F.expr(
        f"filter(transform(__m, (m, i) -> struct(__st[i] as start, __st[i] + length(m) as end, {told} as disclosure)), t -> t.disclosure is not null)")
    ).drop("__m", "__g", "__st", "__told")


def _with_terms_apart(df: DataFrame, out: str) -> DataFrame:
    """Add the ``__terms`` that overlap none of ``__spans``. Spans of one kind are apart and sorted: the last of a
    kind that starts before the term's end is the only one to look at."""
    df = df.withColumns({f"__e_{k}": F.expr(f"filter(__spans, s -> s.kind = '{k}')") for k in KINDS})
    hit = " or ".join(_search(f"__e_{k}", "start", "t.end", f"coalesce(get(__e_{k}, n - 1).end > t.start, false)") for k in KINDS)
    return df.withColumn(out, F.expr(
        f"filter(coalesce(__terms, cast(array() as array<struct<start:int,end:int,disclosure:double>>)), t -> not ({hit}))")
    ).drop(*[f"__e_{k}" for k in KINDS])


def _between(start: str, end: str) -> str:
    """The text from ``start`` to ``end``, taken out of ``__blocks``: a long text is not walked from its start."""
    return (f"if({end} <= {start}, '', substring(array_join(slice(__blocks, {start} div {BLOCK} + 1, "
            f"({end} - 1) div {BLOCK} - {start} div {BLOCK} + 1), ''), {start} % {BLOCK} + 1, {end} - {start}))")


def find_personal_data(docs: DataFrame, everywhere: bool = False) -> DataFrame:
    """One row per input row: ``doc_id``, ``identifiers`` (kind, start, end, value, before, after; by kind,
    then start) and ``terms`` (start, end, disclosure; by start): those of texts with an identifier, or ``everywhere``.

    A null text is an empty one. Equal rows get equal results. Null and repeated doc_ids are rows
    like any other. No rows give no rows; other columns are ignored. In a very long text, finding identifiers
    and placing terms takes time in proportion to their number; judging them pairs each identifier
    that has ``SUPPORT`` contexts with each term of its text that is rare enough to disclose it."""
    keyed = _keyed(docs)
    found = with_identifiers(keyed).withColumn("__text", F.when(F.size("__spans") > 0, F.col("__text")))
    return _with_terms_apart(with_terms(keyed, stored(found, "identifiers"), everywhere), "terms").select(
        F.col("__id").alias("doc_id"), F.col("__spans").alias("identifiers"), "terms")


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with identifiers replaced by their kind, and disclosing terms generalised or removed.

    Overlapping spans are replaced as one. Texts without identifiers, null ones too, stay as they
    are and are not shuffled; a changed row's ``n_chars``, if there is one, is its new length."""
    row = F.struct(*[docs[c] for c in docs.columns]).alias("__row")
    text = F.coalesce(docs["text"], F.lit(""))
    maybe = any_of([text.rlike(p) for p in PATTERNS.values()])
    held = stored(with_identifiers(_keyed(docs.where(maybe), row)), "personal")
    found = held.where("size(__spans) > 0")
    gaps = _with_terms_apart(with_terms(_keyed(docs), found), "__t")
    gaps = gaps.withColumn("__c", F.expr(
        "array_sort(concat(transform(__spans, s -> struct(s.start as s, s.end as e, concat('[', upper(s.kind), ']') as l)), "
        f"transform(__t, t -> struct(t.start as s, t.end as e, if(t.disclosure >= {REMOVE}, '', '[TERM]') as l))))"))
    gaps = gaps.withColumn("__ends", F.col("__c.e")).withColumn("__till", F.expr(_running("__ends", "greatest(v, x)")))
    gaps = gaps.withColumn("__blocks", F.regexp_extract_all("__text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))
    # What starts inside an earlier span is part of it; what does not puts the text since then and its own label.
    gaps = gaps.withColumn("__new", F.expr(
        f"concat(array_join(transform(__c, (x, i) -> if(x.s < __till[i], '', concat({_between('__till[i]', 'x.s')}, x.l))), ''), "
        f"{_between('__till[size(__c)]', 'length(__text)')})"))
    new = {"text": F.col("__new"), "n_chars": F.length("__new")}
    kinds = dict(docs.dtypes)
    changed = gaps.select(*[(new[c].cast(kinds[c]) if c in new else F.col("__row").getField(c)).alias(c) for c in docs.columns])
    untouched = held.where("size(__spans) = 0").select("__row.*")
    return docs.where(~maybe).unionByName(untouched).unionByName(changed)
