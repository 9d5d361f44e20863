"""Principal and policy text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# IAM member kinds a grant may name.
VALID_MEMBER_PATTERN = r"^(user:|group:|serviceAccount:)"
# Repository named by a workload-identity member.
MEMBER_REPO_PATTERN = r".*attribute\.repository/([^\"]*)"
# Repository named by a provider's attribute condition, either quote.
CONDITION_REPO_PATTERN = r"""assertion\.repository\s*==\s*['"]([^'"]*)['"]"""


def with_prefix(email: Column, prefix: str) -> Column:
    """``prefix + email`` unless the email already names a service account."""
    return F.when(email.startswith("serviceAccount:"), email).otherwise(
        F.concat(F.lit(prefix), email))


def user_member(email: Column) -> Column:
    return with_prefix(email, "user:")


def is_valid_member(member: Column) -> Column:
    return F.coalesce(member.rlike(VALID_MEMBER_PATTERN), F.lit(False))


def repo_from_member(member: Column) -> Column:
    return F.regexp_extract(member, MEMBER_REPO_PATTERN, 1)


def repo_from_condition(cond: Column) -> Column:
    return F.regexp_extract(F.coalesce(cond, F.lit("")), CONDITION_REPO_PATTERN, 1)


def permission_label(name: Column) -> Column:
    """``can_read_data`` -> ``Can Read Data``."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def quote_regex(text: str) -> str:
    """Literal text as a regex (the account name is matched, not parsed)."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"
