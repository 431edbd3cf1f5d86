"""Who may see what: tenant scope, default tenant, memberships, staff listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import text
from parley.operators.groups import in_order, oldest

# Fixed values
SUPERADMIN = "superadmin"
ADMIN = "admin"
MANAGER = "manager"


def scope(df: DataFrame, users: DataFrame, memberships: DataFrame, user_id, tenant_id=None) -> DataFrame:
    """Rows of ``df`` one user may see: all for a superadmin, else those of the user's tenants.

    With ``tenant_id`` the result is that tenant's rows, empty when out of reach.
    """
    is_super = users.where((F.col("user_id") == user_id) & (F.col("role") == SUPERADMIN)).exists()
    own = memberships.where(F.col("user_id") == user_id).select("tenant_id", F.lit(True).alias("_member"))
    rows = df if tenant_id is None else df.where(F.col("tenant_id") == tenant_id)
    seen = rows.join(own, "tenant_id", "left").where(F.coalesce("_member", F.lit(False)) | is_super)
    return seen.drop("_member")


def visible_counts(df: DataFrame, users: DataFrame, memberships: DataFrame) -> DataFrame:
    """Rows of ``df`` each user may see.

    Rows are counted per tenant before they meet the memberships, so nothing
    multiplies rows by users; superadmins get the grand total.
    """
    per_tenant = df.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    per_user = memberships.join(per_tenant, "tenant_id").groupBy("user_id").agg(F.sum("n").alias("n"))
    return users.join(per_user, "user_id", "left").select(
        "user_id",
        "role",
        F.when(F.col("role") == SUPERADMIN, total).otherwise(F.coalesce("n", F.lit(0))).alias("visible_rows"),
    )


def effective_tenant(users: DataFrame, memberships: DataFrame, tenants: DataFrame) -> DataFrame:
    """Tenant each user starts in: a superadmin the oldest one, others the token's if accessible, else their first."""
    eldest = tenants.agg(F.min_by("tenant_id", F.struct("created_at", "tenant_id"))).scalar()
    picked = (
        memberships.join(users.select("user_id", "token_tenant_id"), "user_id")
        .groupBy("user_id")
        .agg(
            F.max(F.when(F.col("tenant_id") == F.col("token_tenant_id"), F.col("tenant_id"))).alias("from_token"),
            F.min_by("tenant_id", F.struct("ord", "tenant_id")).alias("first_joined"),
        )
    )
    choice = F.when(F.col("role") == SUPERADMIN, eldest).otherwise(F.coalesce("from_token", "first_joined"))
    return users.join(picked, "user_id", "left").select("user_id", "role", choice.alias("tenant_id"))


def origin_allowed(requests: DataFrame, tenants: DataFrame, global_list: str = "*") -> DataFrame:
    """Flag requests whose origin is on the tenant's list, or on the global list where the tenant has none."""

    def entries(col: Column) -> Column:
        return F.filter(F.transform(F.split(col, ","), text.strip_ws), lambda o: o != "")

    listed = F.nullif(F.col("cors_allowed_origins"), F.lit(""))
    own = entries(listed)
    origin = F.nullif(F.col("origin"), F.lit(""))
    on_list = lambda allowed: F.coalesce(F.array_contains(allowed, origin), F.lit(False))
    shared = [o.strip() for o in global_list.split(",") if o.strip()]
    anyone = global_list.strip() == "*" or not shared
    by_global = F.lit(True) if anyone else F.coalesce(origin.isin(shared), F.lit(False))
    verdict = (
        F.when(listed.isNull(), by_global).when(F.array_contains(own, "*"), F.lit(True)).otherwise(on_list(own))
    )
    lists = tenants.select("tenant_id", "cors_allowed_origins")
    return requests.join(lists, "tenant_id", "left").withColumn("allowed", verdict).drop("cors_allowed_origins")


def membership_detail(memberships: DataFrame, tenants: DataFrame) -> DataFrame:
    """Memberships with the tenant's name, NULL when the tenant is gone."""
    names = tenants.select("tenant_id", F.col("name").alias("tenant_name"))
    return memberships.join(names, "tenant_id", "left")


def tenant_users(users: DataFrame, memberships: DataFrame, ordered: bool = False) -> DataFrame:
    """Non-superadmin users of each tenant, newest first if ``ordered``."""
    staff = users.where(F.col("role") != SUPERADMIN)
    rows = (
        memberships.select("tenant_id", "user_id")
        .join(staff.select("user_id", "email", "role", "is_active", "created_at"), "user_id")
    )
    return in_order(rows, ordered, "tenant_id", F.desc("created_at"), "user_id")


def tenant_actor(memberships: DataFrame, users: DataFrame) -> DataFrame:
    """First active member of each tenant by membership order."""
    active = users.where("is_active").select("user_id")
    members = memberships.join(active, "user_id", "left_semi").select("tenant_id", "ord", "user_id")
    return oldest(members, ["tenant_id"], ["ord", "user_id"]).select("tenant_id", F.col("user_id").alias("actor_user_id"))


def job_listing(jobs: DataFrame, tenants: DataFrame, tenant_id=None, ordered: bool = False) -> DataFrame:
    """Jobs with the name of their tenant (own id, else the target in the JSON), newest first if ``ordered``.

    ``tenant_id`` keeps jobs that name the tenant in either place.
    """
    target = F.get_json_object("meta_json", "$.target_tenant_id")
    own = F.col("tenant_id").cast("string")
    rows = jobs.withColumn("target_tenant_id", target)
    if tenant_id is not None:
        rows = rows.where((own == str(tenant_id)) | (F.col("target_tenant_id") == str(tenant_id)))
    names = tenants.select(F.col("tenant_id").cast("string").alias("_key"), F.col("name").alias("tenant_name"))
    rows = (
        rows.withColumn("_key", F.coalesce(own, F.col("target_tenant_id")))
        .join(names, "_key", "left")
        .drop("_key")
    )
    return in_order(rows, ordered, F.desc("created_at"), "job_id")


def reconcile_memberships(current: DataFrame, target: DataFrame, users: DataFrame, tenants: DataFrame) -> DataFrame:
    """Rows to add and to remove so that ``current`` becomes ``target``, and the users whose target is refused.

    Every user has a target set, possibly empty.  A manager needs exactly one
    tenant, an admin at least one, superadmins take none, and all must exist; a
    refused user keeps the current rows.
    """
    wanted = target.select("user_id", "tenant_id").distinct()
    known = tenants.select("tenant_id", F.lit(1).alias("_known"))
    sets = (
        wanted.join(known, "tenant_id", "left")
        .groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_known").isNull()).alias("missing"))
    )
    n = F.coalesce("n", F.lit(0))
    reason = (
        F.when((F.col("role") == MANAGER) & (n != 1), "manager needs exactly one tenant")
        .when((F.col("role") == ADMIN) & (n < 1), "admin needs at least one tenant")
        .when((F.col("role") == SUPERADMIN) & (n > 0), "superadmin is managed by role")
        .when(F.col("missing") > 0, "unknown tenant")
    )
    judged = users.join(sets, "user_id", "left").select("user_id", "role", reason.alias("reason"))
    passed = judged.where(F.col("reason").isNull() & (F.col("role") != SUPERADMIN)).select("user_id")
    have = current.select("user_id", "tenant_id")
    pair = ["user_id", "tenant_id"]
    change = lambda rows, action: rows.join(passed, "user_id", "left_semi").select(
        *pair, F.lit(action).alias("action"), F.lit(None).cast("string").alias("reason")
    )
    refused = judged.where(F.col("reason").isNotNull()).select(
        "user_id", F.lit(None).cast("bigint").alias("tenant_id"), F.lit("refuse").alias("action"), "reason"
    )
    added = change(wanted.join(have, pair, "left_anti"), "add")
    removed = change(have.join(wanted, pair, "left_anti"), "remove")
    return added.unionByName(removed).unionByName(refused)
