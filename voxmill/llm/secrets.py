"""Secret scans over an incremental ledger of content-addressed blobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxmill.llm import common


@dataclass(frozen=True)
class Rule:
    """A pattern whose leftmost matches that do not overlap are findings if ``group`` has ``least`` characters or more.

    ``hint`` matches somewhere in every text that has a finding; it spares most texts the search for positions.
    """

    kind: str
    pattern: str
    hint: str
    group: int = 0
    least: int = 1
    version: int = 1


#: Letters of the keywords in either case; only ASCII letters are meant.
_KEYWORDS = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token", "api_?key"))

RULES = (
    Rule("assign", rf"""({_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", rf"""({_KEYWORDS})["']?\x20*[:=]""", group=2, least=6),
    Rule("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]{16}", least=20),
    Rule("hex", "[0-9a-f]+", "[0-9a-f]{24}", least=24),
)
#: What is found besides: heads of private keys, signed web tokens, credentials in URLs, and keys whose issuers mark them with a prefix.
MORE_RULES = (
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ"),
    Rule("url_login", r"[A-Za-z][A-Za-z0-9+.-]*://[^\x20\x09-\x0D/@:]+:[^\x20\x09-\x0D/@]+@", r"://[^\x20\x09-\x0D/@:]+:[^\x20\x09-\x0D/@]+@"),
    Rule("issued_key", "(?:gh[pousr]_|glpat-|xox[abprs]-|sk_live_|AIza)[A-Za-z0-9_-]+", "gh[pousr]_|glpat-|xox[abprs]-|sk_live_|AIza", least=24),
)
ALL_RULES = RULES + MORE_RULES

LEDGER = "blob string, kind string, version int, spans array<struct<start:bigint,end:bigint>>"


def blob_id(text: Column) -> Column:
    """The content address: SHA-256 of the text's UTF-8 bytes; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _matches(text: Column, rule: Rule, order: int) -> Column:
    """An array with a struct for each match: the rule's place, the match's number, the gap before it, its length, whether it counts."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    both = F.arrays_zip(found.alias("m"), kept.alias("g"), F.split(text, rule.pattern, -1).alias("gap"))
    structs = F.transform(
        both,
        lambda x, i: F.struct(
            F.lit(order).alias("rule"), i.alias("i"), F.length(x["gap"]).alias("gap"), F.length(x["m"]).alias("len"), (F.length(x["g"]) >= rule.least).alias("counts")
        ),
    )
    return F.filter(structs, lambda x: x["len"].isNotNull())  # the text behind the last match is a gap without a match


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = ALL_RULES) -> DataFrame:
    """``(blob, kind, version, spans)`` of each of ``blobs(blob, content, todo)`` and each rule whose place is in ``todo``.

    Spans are code points, the end exclusive. Rows without findings come too: the ledger notes that the pair was scanned.
    """
    hits = []
    for k, rule in enumerate(rules):
        hits.append(F.when(F.array_contains("todo", k) & F.col("content").rlike(rule.hint), _matches(F.col("content"), rule, k)))
    one = "struct<rule:int,i:int,gap:int,len:int,counts:boolean>"
    found = blobs.select("blob", "todo", F.concat(*[F.coalesce(x, F.array().cast(f"array<{one}>")) for x in hits]).alias("hits"))
    rows = found.select("blob", "todo", F.explode_outer("hits").alias("h")).select("blob", "todo", "h.*")
    upto = W.partitionBy("blob", "rule").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto).cast("long")).withColumn("start", F.col("end") - F.col("len"))
    spans = rows.groupBy("blob").agg(
        F.first("todo").alias("todo"), F.sort_array(F.collect_list(F.when(F.col("counts"), F.struct("rule", "start", "end")))).alias("all")
    )
    kinds, versions = F.array(*[F.lit(r.kind) for r in rules]), F.array(*[F.lit(r.version) for r in rules])
    mine = F.transform(F.filter("all", lambda s: s["rule"] == F.col("k")), lambda s: F.struct(s["start"], s["end"]))
    return (
        spans.select("blob", "all", F.explode("todo").alias("k"))
        .select("blob", kinds[F.col("k")].alias("kind"), versions[F.col("k")].alias("version"), mine.alias("spans"))
    )


def unseen(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = ALL_RULES, text_col: str = "text") -> DataFrame:
    """``(blob, content, todo)``: each distinct text once, with the places of the rules that the ledger lacks for it."""
    everything = F.array(*[F.lit(k) for k in range(len(rules))])
    content = F.coalesce(F.col(text_col), F.lit(""))
    versions = docs.select(blob_id(F.col(text_col)).alias("blob"), content.alias("content"))
    if ledger is None:
        return versions.groupBy("blob").agg(F.first("content").alias("content")).withColumn("todo", everything)
    places = F.coalesce(*[F.when((F.col("kind") == r.kind) & (F.col("version") == r.version), F.lit(k)) for k, r in enumerate(rules)])
    seen = ledger.select("blob", places.alias("k")).filter("k IS NOT NULL").groupBy("blob").agg(F.collect_set("k").alias("seen"))
    todo = F.array_except(everything, F.coalesce("seen", F.array().cast("array<int>")))
    # blobs of which every rule was seen go before their texts are moved
    left = versions.join(seen.filter(F.size("seen") == len(rules)).select("blob"), "blob", "left_anti")
    left = left.groupBy("blob").agg(F.first("content").alias("content"))
    return left.join(seen, "blob", "left").select("blob", "content", todo.alias("todo"))


def update(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = ALL_RULES, text_col: str = "text") -> DataFrame:
    """The rows to append to the ledger: findings of the (blob, rule version) pairs that it lacks. Schema: ``LEDGER``."""
    return scan(unseen(docs, ledger, rules, text_col), rules)


def findings(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = ALL_RULES, text_col: str = "text") -> DataFrame:
    """``docs`` with ``blob`` and ``found``: the spans of the current rule versions, by start and then in the rules' order.

    ``found`` is an array of ``(start, rule, kind, end)``, empty where nothing was found. Equal texts, whatever their path or
    version, share the ledger's entry. Input columns of these two names are replaced.
    """
    kept = [c for c in docs.columns if c not in ("blob", "found")]
    places = F.coalesce(*[F.when((F.col("kind") == r.kind) & (F.col("version") == r.version), F.lit(k)) for k, r in enumerate(rules)])
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("rule").alias("rule"), F.col("kind").alias("kind"), s["end"].alias("end")))
    current = ledger.withColumn("rule", places).filter("rule IS NOT NULL AND size(spans) > 0")
    current = current.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list(spans))).alias("found"))
    out = docs.select(*kept, blob_id(F.col(text_col)).alias("blob")).join(current, "blob", "left")
    none = F.array().cast("array<struct<start:bigint,rule:int,kind:string,end:bigint>>")
    return out.select(*kept, "blob", F.coalesce("found", none).alias("found"))


def redact(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = ALL_RULES, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; spans that overlap are merged first. Other rows stay as they are.

    Null texts stay null; ``n_chars`` is counted anew where a text changed. All other columns stay, whatever their names.
    """
    own = ("blob", "found")
    new = update(docs, ledger, rules, text_col)
    known = new if ledger is None else ledger.unionByName(new)
    out = findings(common.aside(docs, *own), known, rules, text_col)
    text = F.col(text_col)
    state = "struct<at:bigint,parts:array<string>>"
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts")).cast(state)

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        fresh = F.struct(s["end"].alias("at"), F.concat(acc["parts"], F.array(gap, F.lit(mark))).alias("parts")).cast(state)
        more = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["parts"].alias("parts")).cast(state)
        return F.when(s["start"] >= acc["at"], fresh).otherwise(more)

    def rest(acc: Column) -> Column:
        return F.concat(F.array_join(acc["parts"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))

    hit = F.size("found") > 0
    out = out.withColumn("_clean", F.when(hit, F.aggregate("found", begin, step, rest)).otherwise(text))
    new = {text_col: F.col("_clean"), "n_chars": F.when(hit, F.length("_clean").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[new[c].alias(c) if new.get(c) is not None else common.back(c, *own) for c in docs.columns])


def digest(found: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def advance(docs: DataFrame, path: str, rules: tuple[Rule, ...] = ALL_RULES, text_col: str = "text") -> DataFrame:
    """The ledger stored at ``path`` after what ``docs`` has and it lacks was scanned and appended; an absent ledger is an empty one.

    ``docs`` may hold any number of versions of any number of paths: a blob that any of them had before is not scanned again, by
    a rule version that has seen it. The rows of one append are written as a whole or, should the job fail, not at all.
    """
    stored = docs.sparkSession.read.schema(LEDGER)
    try:
        before = stored.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        before = None
    update(docs, before, rules, text_col).write.mode("append").parquet(path)
    return stored.parquet(path)


def op9_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, joined back from a ledger that is written and read; it starts empty with each run of the query."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    out = findings(docs, advance(docs, common.scratch_path(spark, "ledger")))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["rule"] < len(RULES))
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("found")).alias("spans"))


QUERIES = {"op9_secret_ledger": op9_secret_ledger}


def _sql(rule: Rule, order: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {order} AS k, '{rule.kind}' AS kind, {rule.least} AS least, regexp_extract_all(t, '{pattern}', 0) AS ms,
         regexp_extract_all(t, '{pattern}', {rule.group}) AS gs, string_split_regex(t, '{pattern}') AS gaps FROM d"""


SQL = {
    "op9_secret_ledger": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_sql(r, k) for k, r in enumerate(ALL_RULES))}),
u AS (SELECT doc_id, k, kind, least, unnest(ms) AS m, unnest(gs) AS g, unnest(gaps[1:len(ms)]) AS gap, unnest(range(1, len(ms) + 1)) AS i FROM m WHERE len(ms) > 0),
p AS (
  SELECT doc_id, k, kind, length(g) >= least AS counts, length(m) AS n,
         (sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, k ORDER BY i))::BIGINT AS stop
  FROM u),
f AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS a, count(*) FILTER (WHERE kind = 'access') AS b, count(*) FILTER (WHERE kind = 'hex') AS c,
         string_agg(kind || ':' || (stop - n) || ':' || stop, ',' ORDER BY stop - n, k) AS spans,
         string_agg(kind || ':' || (stop - n) || ':' || stop, ',' ORDER BY stop - n, k) FILTER (WHERE k < {len(RULES)}) AS base
  FROM p WHERE counts GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN f USING (doc_id)
""",
}
