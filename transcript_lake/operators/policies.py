"""Access-policy documents: flatten, search, compare, edit.

Policies are rows ``(resource, policy)`` with ``policy`` a JSON document
``{"bindings": [{"role": ..., "members": [...]}]}``; one resource may be
stored in several documents. Flattened bindings are rows
``(resource, role, member)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.principals import repo_from_condition, repo_from_member
from ..sources.schemas import CORRUPT, POLICY, with_corrupt

WORKLOAD_IDENTITY_ROLE = "roles/iam.workloadIdentityUser"
KEYS = ["resource", "role", "member"]


def _parsed(policies: DataFrame) -> DataFrame:
    p = F.from_json("policy", with_corrupt(POLICY), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    broken = F.col("p").isNull() | F.col(f"p.{CORRUPT}").isNotNull()
    why = F.when(F.col("policy").isNull(), "policy: missing").when(broken, "policy: malformed")
    return policies.select("resource", "policy", F.explode(F.array(p)).alias("p")).withColumn("errors", why)


def parse_policy(policies: DataFrame) -> DataFrame:
    """(resource, p) of the well-formed documents; ``policy_errors`` has the others."""
    return _parsed(policies).where("errors is null").select("resource", "p")


def policy_errors(policies: DataFrame) -> DataFrame:
    """(resource, policy, errors) of the documents that are null or not JSON of the declared shape."""
    return _parsed(policies).where("errors is not null").select("resource", "policy", "errors")


def flatten_policy(policies: DataFrame) -> DataFrame:
    """One row per (resource, role, member): parse, then explode twice."""
    return (parse_policy(policies)
            .select("resource", F.explode("p.bindings").alias("b"))
            .select("resource", F.col("b.role").alias("role"),
                    F.explode("b.members").alias("member")))


def members_with_role(flat: DataFrame, role: str = WORKLOAD_IDENTITY_ROLE) -> DataFrame:
    return flat.filter(F.col("role") == role).select("resource", "member")


def members_like(flat: DataFrame, prefix: str) -> DataFrame:
    """Flattened bindings whose member starts with ``prefix``."""
    return flat.filter(F.col("member").startswith(prefix))


def policy_has_member(policies: DataFrame, prefix: str) -> DataFrame:
    """Resources whose policy names a member starting with ``prefix``,
    tested on the nested document without flattening it."""
    hit = F.exists(F.col("p.bindings"),
                   lambda b: F.exists(b["members"], lambda m: m.startswith(prefix)))
    return parse_policy(policies).filter(hit).select("resource").distinct()


def stale_bindings(flat: DataFrame, stale: DataFrame) -> DataFrame:
    """Listed (resource, role, member) triples that the policy does hold.

    The lookup side is de-duplicated first, so repeated triples collapse
    map-side; a hot triple on the policy side is split by AQE's skew join.
    """
    return flat.join(stale.select(KEYS).distinct(), KEYS, "left_semi")


def remove_bindings(flat: DataFrame, stale: DataFrame) -> DataFrame:
    """The policy without the listed triples; all other bindings kept."""
    return flat.join(stale.select(KEYS).distinct(), KEYS, "left_anti")


def ensure_bindings(flat: DataFrame, wanted: DataFrame) -> DataFrame:
    """Add each wanted triple only where it is missing (running it twice
    gives the same rows as once)."""
    missing = wanted.select(KEYS).distinct().join(flat.select(KEYS).distinct(), KEYS, "left_anti")
    return flat.select(KEYS).unionByName(missing)


def missing_role(policies: DataFrame, flat: DataFrame,
                 role: str = WORKLOAD_IDENTITY_ROLE) -> DataFrame:
    """Resources that have a policy but no binding of ``role``.

    A resource with a document that cannot be read is not reported: what it
    binds is unknown (``policy_errors`` reports it). Readability is folded into
    the same aggregation that makes the resources distinct.
    """
    have = flat.filter(F.col("role") == role).select("resource").distinct()
    known = (_parsed(policies).groupBy("resource").agg(F.count("errors").alias("unread"))
             .where("unread = 0").select("resource"))
    return known.join(have, "resource", "left_anti")


def repo_mismatch(flat: DataFrame, providers: DataFrame) -> DataFrame:
    """Workload-identity members whose repository differs from the one the
    resource's provider condition names. An empty configured repository is
    not a mismatch. The provider side is one row per resource; Catalyst/AQE
    broadcast it when its measured size allows, else it is a shuffled join."""
    bound = (flat.filter(F.col("role") == WORKLOAD_IDENTITY_ROLE)
             .select("resource", "member", repo_from_member(F.col("member")).alias("bound_repo"))
             .filter(F.col("bound_repo") != ""))
    configured = (providers
                  .select("resource", repo_from_condition(F.col("condition")).alias("configured_repo"))
                  .filter(F.col("configured_repo") != ""))
    return (bound.join(configured, "resource")
            .filter(F.col("bound_repo") != F.col("configured_repo"))
            .select("resource", "member", "bound_repo", "configured_repo",
                    F.col("configured_repo").contains("-").alias("hyphen_warning")))
