"""Deterministic roles, cutoffs, eligibility and bootstrap rosters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.functions.hashing import digest, hash_mod, replicate_picks
from varve.functions.numeric import reasons, status
from varve.operators.ordering import dense_index, hash_rank, id_blocks

# The default role shares and the fewest distinct eligible entities a stage may have.
ROLE_SHARES = (("fit", 55), ("tune", 15), ("calibration", 30))
STAGE_MINIMUM = {"fit": 20, "tune": 5, "calibration": 9}


def assign_roles(
    entities: DataFrame, seed: str, shares: Sequence[tuple[str, int]] = ROLE_SHARES, id_col: str = "entity_id"
) -> DataFrame:
    """Order entities by SHA-256 of ``seed|split|id`` and cut that order at the cumulative shares."""
    hashed = entities.withColumn("split_hash", digest(seed, "split", F.col(id_col)))
    ranked = hash_rank(hashed, "split_hash", id_col, "split_rank")
    whole = sum(share for _, share in shares)
    role, reached = F.lit(None).cast("string"), 0
    conds = []
    for name, share in shares:
        reached += share
        conds.append((F.col("split_rank") <= F.floor(F.col("n_all") * F.lit(reached) / F.lit(whole)), name))
    for cond, name in reversed(conds):
        role = F.when(cond, F.lit(name)).otherwise(role)
    return ranked.withColumn("role", role).drop("n_all")


def cutoff_column(seed: str, low: int, width: int, id_col: str = "entity_id", tag: str | Column = "cutoff") -> Column:
    """Pseudo-cutoff ``low + hash mod width``, independent of the lifetime."""
    return F.lit(low) + hash_mod(seed, tag, F.col(id_col), width)


def alternate_cutoff_column(seed: str, salt: str | None, low: int, width: int, id_col: str = "entity_id", mode: str = "alternate") -> Column:
    """Cutoff from a salt. The canonical mode takes none; a salt must be non-empty and free of ``|``."""
    if mode == "canonical":
        if salt is not None:
            raise ValueError("the canonical mode takes no salt")
        return cutoff_column(seed, low, width, id_col)
    if mode != "alternate":
        raise ValueError("mode must be 'canonical' or 'alternate'")
    if not isinstance(salt, str) or not salt.strip() or "|" in salt:
        raise ValueError("the alternate mode needs a non-empty salt without '|'")
    return cutoff_column(seed, low, width, id_col, salt)


def with_eligibility(df: DataFrame, cutoff: str = "cutoff", lifetime: str = "lifetime") -> DataFrame:
    """Flag entities still alive at their cutoff (strict); ineligible rows stay."""
    return df.withColumn("eligible", F.col(cutoff) < F.col(lifetime))


def endpoint_cutoffs(rows: DataFrame, id_col: str = "entity_id") -> DataFrame:
    """Cutoff of an unseen entity: its last observed cycle, however short."""
    return rows.groupBy(id_col).agg(F.max("cycle").alias("cutoff"))


def role_rosters(entities: DataFrame, id_col: str = "entity_id", block: int = 1 << 14) -> DataFrame:
    """Position 1..n of each entity inside its role, ids ascending, and the role size."""
    cut = id_blocks(entities.select(id_col, "role"), id_col, "_block", block)
    numbered = dense_index(cut, ["role"], ["_block"], [id_col], "slot").drop("_block")
    sizes = entities.groupBy("role").agg(F.count(F.lit(1)).alias("n_role"))
    return numbered.join(sizes, "role")


def bootstrap_picks(rosters: DataFrame, replicates: int, seed: str) -> DataFrame:
    """The position every role slot of every replicate draws, a hash of (replicate, role, slot)."""
    return replicate_picks(rosters, replicates, seed, "role", "n_role", by_first=False)


def bootstrap_draws(rosters: DataFrame, replicates: int, seed: str, id_col: str = "entity_id") -> DataFrame:
    """Role-stratified resampling with replacement: every role slot of every replicate draws one entity.

    The drawn position is a hash of (replicate, role, slot), so the draws do not depend on cutoffs
    and the same seed pairs the canonical and the alternate cutoff mode.
    """
    pool = rosters.select("role", F.col("slot").alias("_pick"), id_col)
    return bootstrap_picks(rosters, replicates, seed).join(pool.hint("shuffle_hash"), ["role", "_pick"]).drop("_pick")


def stage_multiplicities(draws: DataFrame, id_col: str = "entity_id") -> DataFrame:
    """How often each entity was drawn, per replicate and role."""
    return draws.groupBy("replicate", "role", id_col).agg(F.count(F.lit(1)).alias("multiplicity"))


def stage_summary(
    multiplicities: DataFrame, eligibility: DataFrame, minimum: Mapping[str, int] = STAGE_MINIMUM, id_col: str = "entity_id"
) -> DataFrame:
    """Per replicate and role: draws, distinct and eligible counts, and the minimum gate. Nothing is redrawn."""
    joined = multiplicities.join(eligibility.select(id_col, "eligible"), id_col)
    counts = joined.groupBy("replicate", "role").agg(
        F.sum("multiplicity").alias("draws"),
        F.count(F.lit(1)).alias("unique_drawn"),
        F.count_if("eligible").alias("eligible_unique"),
        F.coalesce(F.sum(F.when(F.col("eligible"), F.col("multiplicity"))), F.lit(0)).alias("eligible_draws"),
    )
    need = F.lit(None).cast("int")
    for role, least in minimum.items():
        need = F.when(F.col("role") == role, F.lit(least)).otherwise(need)
    gated = counts.withColumn("minimum_unique", need)
    failures = reasons({"too_few_distinct_eligible": F.col("eligible_unique") < F.col("minimum_unique")})
    return gated.withColumn("status", status(failures))


def anchor_cohort(landmarks: DataFrame, role: str = "calibration", outcome: Sequence[str] = ("y", "remaining")) -> DataFrame:
    """Eligible entities of one role with every outcome column removed from the schema."""
    return landmarks.filter((F.col("role") == role) & F.col("eligible")).drop(*outcome)


def behind_selection(calibration: DataFrame, selection: DataFrame, key: str = "dataset") -> DataFrame:
    """Calibration rows joined to the frozen selection record of their data set.

    Without a frozen record no calibration row comes back, so outcomes cannot be read early.
    """
    frozen = selection.filter(F.col("frozen")).select(key, "candidate_id")
    return calibration.join(frozen, key)
