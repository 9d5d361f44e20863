"""Access lists turned into grants.

Access lists are long rows ``(list, email)`` with ``list`` one of owner,
writer, reader; the two group names and the pipeline account are scalar
settings (empty text means "none"). Every operator here is a narrow
projection or a ``distinct``; no group is ever gathered into one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.principals import is_valid_member, user_member

# Dataset role granted to each access list.
OWNER_ROLE = "roles/bigquery.dataOwner"
EDITOR_ROLE = "roles/bigquery.dataEditor"
VIEWER_ROLE = "roles/bigquery.dataViewer"
ROLE_OF_LIST = {"owner": OWNER_ROLE, "writer": EDITOR_ROLE, "reader": VIEWER_ROLE}
# Project roles every listed user gets for the logs.
LOG_ROLES = ["roles/logging.viewer", "roles/logging.viewAccessor"]


@dataclass(frozen=True)
class AccessSettings:
    ml_team_group: str = ""
    analysts_group: str = ""
    ml_pipeline_sa: str = ""


def _role_map():
    pairs = []
    for k, v in ROLE_OF_LIST.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.create_map(*pairs)


def normalize_principals(access: DataFrame) -> DataFrame:
    """Each listed email as an IAM member: ``user:`` unless already an account."""
    return access.select("list", "email", user_member(F.col("email")).alias("member"))


def _settings_rows(access: DataFrame, rows: list[tuple[str, str]], cols: tuple[str, str]) -> DataFrame:
    """Rows from scalar settings, skipping empty values, as literal rows."""
    kept = [(a, b) for a, b in rows if b]
    spark = access.sparkSession
    structs = [F.struct(F.lit(a).alias(cols[0]), F.lit(b).alias(cols[1])) for a, b in kept]
    if not structs:
        return spark.range(0).select(F.lit(None).cast("string").alias(cols[0]),
                                     F.lit(None).cast("string").alias(cols[1]))
    return spark.range(1).select(F.inline(F.array(*structs)))


def expand_grants(access: DataFrame, settings: AccessSettings) -> DataFrame:
    """(role, member) rows of the three dataset role bindings, as a bag.

    Users map through a literal role map (no join); groups and the pipeline
    account come from the settings and are left out when empty.
    """
    users = access.select(
        _role_map()[F.col("list")].alias("role"),
        user_member(F.col("email")).alias("member"))
    sa = settings.ml_pipeline_sa
    sa_member = sa if not sa or sa.startswith("serviceAccount:") else "serviceAccount:" + sa
    extra = _settings_rows(access, [
        (EDITOR_ROLE, "group:" + settings.ml_team_group if settings.ml_team_group else ""),
        (EDITOR_ROLE, sa_member),
        (VIEWER_ROLE, "group:" + settings.analysts_group if settings.analysts_group else ""),
    ], ("role", "member"))
    return users.filter(F.col("role").isNotNull()).unionByName(extra)


def all_users(access: DataFrame) -> DataFrame:
    """Every listed email once, whatever lists it is on."""
    return access.select("email").distinct()


def log_viewers(access: DataFrame) -> DataFrame:
    """Each distinct user gets both log roles (members normalized like R1)."""
    return (all_users(access)
            .select(F.explode(F.array(*[F.lit(r) for r in LOG_ROLES])).alias("role"),
                    user_member(F.col("email")).alias("member")))


def grant_summary(access: DataFrame, settings: AccessSettings) -> DataFrame:
    """Configured access per group as distinct ``(access_group, member)`` rows.

    The source prints each group as one list; rows keep a group of any size
    spread over tasks instead of gathering it into one value.
    """
    group_of_list = F.create_map(
        F.lit("owner"), F.lit("data_owners"),
        F.lit("writer"), F.lit("data_editors"),
        F.lit("reader"), F.lit("data_viewers"))
    users = access.select(group_of_list[F.col("list")].alias("access_group"),
                          F.col("email").alias("member"))
    extra = _settings_rows(access, [
        ("data_editors", settings.ml_pipeline_sa),
        ("editor_groups", settings.ml_team_group),
        ("viewer_groups", settings.analysts_group),
    ], ("access_group", "member"))
    return users.filter(F.col("access_group").isNotNull()).unionByName(extra).distinct()


def invalid_members(df: DataFrame, member: str = "member") -> DataFrame:
    """Rows whose member lacks a ``user:``, ``group:`` or ``serviceAccount:`` prefix."""
    return df.filter(~is_valid_member(F.col(member)))

