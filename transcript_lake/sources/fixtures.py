"""Fixture tables derived from the test data by fixed rules.

The rules (FIXTURES.md section 2) are plain column expressions, so the SQL
oracle can apply them too. None gathers a group into one task: the policy
documents are cut into parts of at most 1,000 customers each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.principals import repo_from_condition
from ..functions.text import char_count, word_count
from ..operators.features import features
from ..operators.grants import AccessSettings
from ..operators.policies import WORKLOAD_IDENTITY_ROLE

# The access settings of the fixture deployment.
ACCESS = AccessSettings(
    ml_team_group="ml@x.com",
    analysts_group="",
    ml_pipeline_sa="ml-pipeline@x.iam.gserviceaccount.com",
)
# Runs of the processed-table history, days before as_of.
RUN_OFFSETS_DAYS = [0, 3, 10]
POLICY_PART_SIZE = 1000


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transcripts_keyed(spark: SparkSession, sf_dir: str, **measures: Column) -> DataFrame:
    """(doc_id, id, created_at, content): each document dated by event doc_id*5.

    ``measures`` (expressions over ``content``) take the place of the text: they are
    computed in the scan, so that where Spark shuffles the join no text is shuffled.
    """
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    docs = docs.select("doc_id", *([m.alias(n) for n, m in measures.items()] or ["content"]))
    # Only every fifth event dates a document; dropping the rest first
    # shrinks the join's build side fivefold.
    ev = (_t(spark, sf_dir, "events").filter(F.col("event_id") % 5 == 0)
          .select("event_id", F.col("ts").alias("created_at")))
    return (docs.join(ev, ev["event_id"] == docs["doc_id"] * 5)
            .select("doc_id", F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("id"),
                    "created_at", *docs.columns[1:]))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts_keyed(spark, sf_dir).select("id", "created_at", "content")


def as_of(spark: SparkSession, sf_dir: str) -> Column:
    """The fixture clock: the newest ``created_at``, as a scalar subquery."""
    return transcripts_keyed(spark, sf_dir).select(F.max("created_at")).scalar()


def processed_runs(spark: SparkSession, sf_dir: str, clock: Column | None = None, text: bool = True) -> DataFrame:
    """Three appended pipeline runs: run j holds rows with doc_id % 3 >= j,
    processed ``RUN_OFFSETS_DAYS[j]`` days before as_of. Features are
    computed once per row, then the row is repeated per run. Without ``text``
    the counts of a text stand in for it (``content`` is null)."""
    clock = clock if clock is not None else as_of(spark, sf_dir)
    keyed = transcripts_keyed(spark, sf_dir) if text else transcripts_keyed(
        spark, sf_dir, word_count=word_count(F.col("content")), char_count=char_count(F.col("content")),
        content=F.lit(None).cast("string"))
    feats = features(keyed, clock)
    offsets = F.array(*[F.lit(d) for d in RUN_OFFSETS_DAYS])
    run = F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int"))).alias("run")
    cols = [c for c in feats.columns if c not in ("doc_id", "processing_timestamp")]
    return (feats.select(*cols, run)
            .select(*cols, (clock - F.make_dt_interval(days=F.element_at(offsets, F.col("run") + 1)))
                    .alias("processing_timestamp")))


def dirty_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads as text with missing and unparseable values."""
    k = F.col("doc_id")
    return transcripts_keyed(spark, sf_dir).select(
        F.when(k % 7 == 0, F.lit(None)).otherwise(F.col("id")).alias("id"),
        F.when(k % 11 == 0, F.lit("bad"))
         .otherwise(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")).alias("created_at"),
        F.when(k % 13 == 0, F.lit(None)).otherwise(F.col("content")).alias("content"),
    )


def access_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(list, email) from customers; some people are on two lists."""
    k = F.col("c_custkey")
    plain = F.concat(F.lit("u"), k.cast("string"), F.lit("@x.com"))
    email = F.concat(F.when(k % 10 == 0, F.lit("serviceAccount:")).otherwise(F.lit("")), plain)
    lists = F.array(F.lit("owner"), F.lit("writer"), F.lit("reader"))
    main = F.struct(F.element_at(lists, (k % 3 + 1).cast("int")).alias("list"), email.alias("email"))
    extra = F.struct(F.lit("reader").alias("list"), plain.alias("email"))
    entries = F.when(k % 50 == 1, F.array(main, extra)).otherwise(F.array(main))
    return _t(spark, sf_dir, "customer").select(F.inline(entries))


def _policy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(resource, role, member, part) per customer, before de-duplication."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    kind = k % 4
    ks = k.cast("string")
    member = (F.when(kind == 0, F.concat(F.lit("user:u"), ks, F.lit("@x.com")))
              .when(kind == 1, F.concat(F.lit("group:g"), ks, F.lit("@x.com")))
              .when(kind == 2, F.concat(F.lit("serviceAccount:s"), ks, F.lit("@x.com")))
              .otherwise(F.concat(F.lit("principalSet://pool/attribute.repository/org/repo-"),
                                  (k % 3).cast("string"))))
    role = F.when(kind == 3, F.lit(WORKLOAD_IDENTITY_ROLE)).otherwise(
        F.concat(F.lit("roles/"), F.lower("c_mktsegment")))
    # Customer-named members stay in their customer's part; the few
    # workload-identity members (3 per resource) form part -1.
    part = F.when(kind == 3, F.lit(-1)).otherwise(F.floor(k / POLICY_PART_SIZE))
    return (_t(spark, sf_dir, "customer")
            .filter(~((kind == 3) & (n % 5 == 0)))
            .select(F.concat(F.lit("p"), n.cast("string")).alias("resource"),
                    role.alias("role"), member.alias("member"), part.alias("part")))


def policy_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (resource, role, member) bindings, one resource per nation."""
    return _policy_rows(spark, sf_dir).select("resource", "role", "member").distinct()


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(resource, policy JSON). Each part of a resource's bindings is one
    document, so no document grows with the data. One aggregation: the
    distinct (role, member) pairs of a part are grouped by role in-row."""
    pairs = (_policy_rows(spark, sf_dir)
             .groupBy("resource", "part")
             .agg(F.array_sort(F.collect_set(F.struct("role", "member"))).alias("pairs")))
    roles = F.array_distinct(F.transform("pairs", lambda p: p["role"]))
    bindings = F.transform(roles, lambda r: F.struct(
        r.alias("role"),
        F.transform(F.filter("pairs", lambda p: p["role"] == r), lambda p: p["member"]).alias("members")))
    return pairs.select("resource", F.to_json(F.struct(bindings.alias("bindings"))).alias("policy"))


def providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(resource, condition): the repository each nation's provider accepts."""
    n = F.col("n_nationkey")
    cond = F.when(n % 6 == 0, F.lit("")).otherwise(
        F.concat(F.lit("assertion.repository == 'org/repo-"), (n % 3).cast("string"), F.lit("'")))
    return _t(spark, sf_dir, "nation").select(
        F.concat(F.lit("p"), n.cast("string")).alias("resource"), cond.alias("condition"))


def stale_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy_flat(spark, sf_dir).filter(F.col("member").like("%repo-2"))


def wanted_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The workload-identity binding each provider's repository needs."""
    repo = repo_from_condition(F.col("condition"))
    return (providers(spark, sf_dir).filter(repo != "")
            .select("resource", F.lit(WORKLOAD_IDENTITY_ROLE).alias("role"),
                    F.concat(F.lit("principalSet://pool/attribute.repository/"), repo).alias("member")))


def audit_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(insert_id, ts, method, target, caller) from events."""
    e = _t(spark, sf_dir, "events")
    method = (F.when(F.col("event_type") == "view", F.lit("GenerateAccessToken"))
              .when(F.col("event_type") == "click", F.lit("GenerateIdToken"))
              .otherwise(F.lit("Other")))
    return e.select(
        F.col("event_id").cast("string").alias("insert_id"),
        "ts",
        method.alias("method"),
        F.concat(F.lit("projects/-/serviceAccounts/sa"), (F.col("event_id") % 5).cast("string")).alias("target"),
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@x.com")).alias("caller"),
        "event_id",
    )


def audit_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit entries as JSON text (``entry``); every 17th lacks authenticationInfo."""
    a = audit_flat(spark, sf_dir)
    auth = F.when(F.col("event_id") % 17 != 0, F.struct(F.col("caller").alias("principalEmail")))
    payload = F.struct(F.col("method").alias("methodName"),
                       F.struct(F.col("target").alias("name")).alias("request"),
                       auth.alias("authenticationInfo"))
    doc = F.struct(F.col("insert_id").alias("insertId"),
                   F.col("ts").cast("string").alias("timestamp"),
                   payload.alias("protoPayload"))
    return a.select(F.to_json(doc).alias("entry"))


def audit_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit entries as a log delivers them: every 19th is cut off, every 23rd has no time,
    every 29th no valid one; the rest have the zone ``Z`` or, every third, ``+05:00``."""
    a, k = audit_flat(spark, sf_dir), F.col("event_id")
    text = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    time = (F.when(k % 23 == 0, F.lit(None)).when(k % 29 == 0, F.lit("yesterday"))
            .when(k % 3 == 0, F.concat(text(F.col("ts") + F.expr("INTERVAL 5 HOURS")), F.lit("+05:00")))
            .otherwise(F.concat(text(F.col("ts")), F.lit("Z"))))
    auth = F.when(k % 17 != 0, F.struct(F.col("caller").alias("principalEmail")))
    payload = F.struct(F.col("method").alias("methodName"), F.struct(F.col("target").alias("name")).alias("request"),
                       auth.alias("authenticationInfo"))
    doc = F.to_json(F.struct(F.col("insert_id").alias("insertId"), time.alias("timestamp"), payload.alias("protoPayload")))
    cut = F.concat(F.lit('{"insertId":"'), "insert_id", F.lit('","timestamp":'))
    return a.select(F.when(k % 19 == 0, cut).otherwise(doc).alias("entry"))


def policies_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policies, those of every fourth nation cut off in the middle."""
    n = F.regexp_extract("resource", "[0-9]+", 0).cast("int")
    return policies(spark, sf_dir).withColumn(
        "policy", F.when(n % 4 == 1, F.lit('{"bindings":[{"role":')).otherwise(F.col("policy")))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight probe results per supplier; five from the bits of its key."""
    k = F.col("s_suppkey")

    def bit(i):
        return F.shiftright(k, i).bitwiseAND(1) == 1
    return _t(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("identity"),
        F.lit(True).alias("dataset_exists"),
        F.lit(True).alias("can_list_tables"),
        F.lit(True).alias("can_get_dataset"),
        bit(2).alias("can_create_table"),
        bit(0).alias("can_read_data"),
        bit(1).alias("can_write_data"),
        bit(3).alias("can_delete_data"),
        bit(4).alias("can_update_dataset"),
    )
