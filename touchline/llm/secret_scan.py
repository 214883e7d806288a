"""Secrets: strong patterns, and weak parts that count only beside their complements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import ROW, numbered

#: fixed values: the three strong kinds
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
#: weak parts
WEAK_ID = r"""((?i:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})"""
WEAK_SECRET = r"""((?i:password|passwd|secret|token|api_?key|pwd|passphrase|credential))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=!@#%^&*-]{6,})"""
ENDPOINT = r"""((?i:https?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp))://([^\x20\x09-\x0D"'<>]{4,})"""

#: kind: pattern, group whose length counts, least length, role
KINDS = {
    "assign": (ASSIGN, 2, 12, "secret"),
    "access": (ACCESS, 0, 18, "id"),
    "hex": (HEX, 0, 16, "secret"),
    "weak_id": (WEAK_ID, 2, 3, "id"),
    "weak_secret": (WEAK_SECRET, 2, 6, "secret"),
    "endpoint": (ENDPOINT, 2, 4, "endpoint"),
}
STRONG = ("assign", "access", "hex")
ROLES = ("id", "secret", "endpoint")
SCOPE = 200


def _found(text: Column, pattern: str, group: int) -> Column:
    """Per match: code points before it since the match before, its length, length of the group."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    # the last gap follows the last match and has no partner
    return F.transform(
        F.arrays_zip(gaps.alias("gap"), F.transform(whole, F.length).alias("size"), F.transform(counted, F.length).alias("counted")),
        lambda m: F.struct(m["gap"].alias("gap"), m["size"].alias("size"), m["counted"].alias("counted")),
    )


def find_parts(docs: DataFrame, row: str = ROW, text: str = "text") -> DataFrame:
    """Every strong or weak match: row, kind, role, start, end in code points."""
    parts = None
    for kind, (pattern, group, least, role) in KINDS.items():
        hits = (
            docs.where(F.col(text).rlike(pattern))
            .select(row, F.posexplode(_found(F.col(text), pattern, group)).alias("at", "m"))
            .where(F.col("m.size").isNotNull())
            .select(row, "at", "m.*")
        )
        before = Window.partitionBy(row).orderBy("at")
        spans = (
            hits.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before))
            .where(F.col("counted") >= least)
            .select(row, F.lit(kind).alias("kind"), F.lit(role).alias("role"), (F.col("end") - F.col("size")).alias("start"), "end")
        )
        parts = spans if parts is None else parts.unionByName(spans)
    return parts


def link_parts(parts: DataFrame, row: str = ROW, scope: int = SCOPE) -> DataFrame:
    """Strong parts, and weak ones with their complements in scope.

    Two parts are in scope if they start at most ``scope`` code points apart in one row. A weak identifier
    needs a secret, a weak secret an identifier, an endpoint both. The interval join goes by (row, bucket
    of ``scope`` code points): a bucket hands its first and last start of each role to itself and to both
    neighbours, so that each part meets one summary however many partners it has.
    """
    placed = parts.withColumn("_bucket", F.floor(F.col("start") / scope))
    summary = placed.groupBy(row, "_bucket", "role").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    offered = summary.select(row, "role", "first", "last", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("_step"), F.col("_bucket").alias("_from"))
    offered = offered.withColumn("_bucket", F.col("_from") + F.col("_step"))
    near = offered.groupBy(row, "_bucket").agg(
        *[F.max(F.when(F.col("role") == r, F.when(F.col("_step") == 0, F.col("first")))).alias(f"{r}_here") for r in ROLES],
        *[F.max(F.when((F.col("role") == r) & (F.col("_step") == 1), F.col("last"))).alias(f"{r}_before") for r in ROLES],
        *[F.min(F.when((F.col("role") == r) & (F.col("_step") == -1), F.col("first"))).alias(f"{r}_after") for r in ROLES],
    )

    def beside(role: str) -> Column:
        return (
            F.col(f"{role}_here").isNotNull()
            | F.coalesce(F.col("start") - F.col(f"{role}_before") <= scope, F.lit(False))
            | F.coalesce(F.col(f"{role}_after") - F.col("start") <= scope, F.lit(False))
        )

    complete = (
        F.when(F.col("kind") == "weak_id", beside("secret"))
        .when(F.col("kind") == "weak_secret", beside("id"))
        .when(F.col("kind") == "endpoint", beside("id") & beside("secret"))
        .otherwise(F.lit(True))
    )
    return placed.join(near, [row, "_bucket"]).where(complete).select(row, "kind", "role", "start", "end")


def scan_secrets(docs: DataFrame, text: str = "text", row: str = ROW, scope: int = SCOPE) -> DataFrame:
    """Row number, kind, role, start and end of every reported span.

    ``docs`` needs the columns ``row`` (a number per row) and ``text``. Null and empty texts have no spans;
    repeated rows have theirs each; other columns are not looked at.
    """
    return link_parts(find_parts(docs, row, text), row, scope)


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of(kind: str):
    return lambda span: span["kind"] == kind


def secret_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per document: counts of the strong kinds, digest of their spans, and all spans as text.

    Rows without secrets, with null or empty text, or with a null ``doc_id`` are returned too; an empty
    table gives an empty result.
    """
    rows = numbered(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    place = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    found = (
        scan_secrets(rows, scope=scope)
        .groupBy(ROW)
        .agg(F.array_sort(F.collect_list(F.struct("start", place[F.col("kind")].alias("place"), "kind", "end"))).alias("all"))
    )
    spans = F.coalesce(F.col("all"), F.array().cast("array<struct<start:bigint,place:int,kind:string,end:bigint>>"))
    base = F.filter(spans, lambda s: s["kind"].isin(*STRONG))
    return rows.select(ROW, "doc_id").join(found, ROW, "left").select(
        "doc_id",
        *[F.size(F.filter(spans, _of(k))).cast("long").alias(f"n_{k}") for k in STRONG],
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(spans).alias("spans"),
    )


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """``docs`` with every reported span replaced by ``mark``; overlapping spans become one.

    All rows and columns stay; a column ``n_chars`` follows the new text.
    """
    rows = numbered(docs)
    order = Window.partitionBy(ROW).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = (
        scan_secrets(rows.select(ROW, text), text, scope=scope)
        .withColumn("_new", (reach.isNull() | (F.col("start") >= reach)).cast("int"))
        .withColumn("_run", F.sum("_new").over(order))
        .groupBy(ROW, "_run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .groupBy(ROW)
        .agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_cut"))
    )
    cut, whole = F.col("_cut"), F.col(text)
    kept = F.transform(
        F.sequence(F.lit(0), F.size(cut)),
        lambda i: F.substring(
            whole,
            (F.when(i == 0, F.lit(0)).otherwise(F.get(cut, i - 1)["end"]) + 1).cast("int"),
            (F.coalesce(F.get(cut, i)["start"], F.length(whole)) - F.when(i == 0, F.lit(0)).otherwise(F.get(cut, i - 1)["end"])).cast("int"),
        ),
    )
    clean = F.when(cut.isNull(), whole).otherwise(F.array_join(kept, mark))
    out = rows.join(runs, ROW, "left").withColumn(text, clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut.isNull(), F.col("n_chars")).otherwise(F.length(text).cast("long")))
    return out.select(*docs.columns)


def report_sql(table: str = "documents", scope: int = SCOPE) -> str:
    """DuckDB text with the result of ``secret_report`` at this scope; it finds partners by comparing parts."""
    hits, quoted = [], {k: v[0].replace("'", "''") for k, v in KINDS.items()}
    for place, (kind, (_, group, least, role)) in enumerate(KINDS.items()):
        hits.append(
            f"""SELECT doc_id, {place} AS place, '{kind}' AS kind, '{role}' AS role, stop - size AS start, stop FROM (
              SELECT doc_id, length(m[n]) AS size, length(c[n]) AS counted,
                sum(length(g[n]) + length(m[n])) OVER (PARTITION BY doc_id ORDER BY n)::BIGINT AS stop
              FROM (SELECT doc_id, m, c, g, unnest(range(1, len(m) + 1)) AS n FROM (
                SELECT doc_id, regexp_extract_all(t, '{quoted[kind]}', 0) AS m, regexp_extract_all(t, '{quoted[kind]}', {group}) AS c,
                  string_split_regex(t, '{quoted[kind]}') AS g FROM texts))) WHERE counted >= {least}"""
        )
    beside = "EXISTS (SELECT 1 FROM parts q WHERE q.doc_id = p.doc_id AND q.role = '{}' AND abs(q.start - p.start) <= " + str(scope) + ")"
    strong = ", ".join(f"'{k}'" for k in STRONG)
    listed = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place)"
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM {table}),
parts AS ({" UNION ALL ".join(hits)}),
spans AS (
  SELECT * FROM parts p WHERE kind IN ({strong})
    OR (kind = 'weak_id' AND {beside.format("secret")})
    OR (kind = 'weak_secret' AND {beside.format("id")})
    OR (kind = 'endpoint' AND {beside.format("id")} AND {beside.format("secret")})
), found AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in STRONG)},
    coalesce({listed} FILTER (kind IN ({strong})), '') AS base, {listed} AS spans
  FROM spans GROUP BY doc_id
)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in STRONG)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts d LEFT JOIN found f USING (doc_id)
"""
