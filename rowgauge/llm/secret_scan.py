"""Secrets, told apart by who else holds them.

Candidates are found in each text. The hashes of their values are then counted
over the whole corpus by distinct repositories and owners: a value that many
owners carry is an example from a manual or a fixture, one that stays with its
owner looks live. Besides the fixed kinds there are free candidates: long runs
that mix capitals, small letters and digits; they count as secrets only where
no more than `max_owners` owners hold them.

Results in odd cases
--------------------
- A null or empty text has no spans.
- Rows that repeat an id are scanned each on its own and counted once as a repository.
- A null owner or repository is one owner or repository of its own.
- Extra columns are dropped, so none can clash.
- An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowgauge.llm import common

#: Fixed patterns; letters of the first stand in both cases so that no engine folds more than A-Z.
ASSIGN = (
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?"
)
VALUE = r"[A-Za-z0-9+/_.=-]+"
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
FREE = r"[A-Za-z0-9+/_=-]{20,}"
#: Cheap test of whether a text can hold any assignment, before the full pattern runs.
HINT = r"[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{8}"
KINDS = ("assign", "access", "hex", "free")


def spans(text: Column, pattern: str, value: str | None = None) -> Column:
    """All leftmost, non-overlapping matches as (start, end, value), in code points.

    The pieces between the matches and the matches themselves alternate, so
    running sums of their lengths are the offsets.
    """
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.split(text, pattern)
    held = (lambda m: F.regexp_extract(m, f"^{value}$", 1)) if value else (lambda m: m)
    walk = F.aggregate(
        F.arrays_zip(gaps.alias("gap"), found.alias("hit")),
        F.struct(
            F.lit(0).cast("long").alias("at"),
            F.array().cast("array<struct<start:bigint,end:bigint,value:string>>").alias("out"),
        ),
        lambda s, x: F.struct(
            (s["at"] + F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))).alias("at"),
            F.when(x["hit"].isNull(), s["out"]).otherwise(
                F.concat(
                    s["out"],
                    F.array(
                        F.struct(
                            (s["at"] + F.length(x["gap"])).alias("start"),
                            (s["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("end"),
                            held(x["hit"]).alias("value"),
                        )
                    ),
                )
            ).alias("out"),
        ),
        lambda s: s["out"],
    )
    return F.when(F.rlike(text, F.lit(pattern)), walk)


def candidates(df: DataFrame, id_col: str, text_col: str, repo_col: str, owner_col: str) -> DataFrame:
    """_row, the id, repository and owner, and one array of spans a kind; texts are read once."""
    text = F.col("_text")
    assign = F.when(F.rlike(text, F.lit(HINT)), spans(text, ASSIGN + VALUE, f"(?:{ASSIGN})({VALUE})"))
    found = df.select(
        F.col(id_col).alias("_id"), F.col(repo_col).alias("_repo"), F.col(owner_col).alias("_owner"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
    ).select(
        F.monotonically_increasing_id().alias("_row"), "_id", "_repo", "_owner",
        F.filter(assign, lambda s: F.length(s["value"]) >= 8).alias("assign"),
        spans(text, ACCESS).alias("access"),
        spans(text, HEX).alias("hex"),
        F.filter(
            spans(text, FREE),
            lambda s: s["value"].rlike("[A-Z]") & s["value"].rlike("[a-z]") & s["value"].rlike("[0-9]"),
        ).alias("free"),
    )
    return common.written(found)


def scan_secrets(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    repo_col: str = "doc_id", owner_col: str = "source", max_owners: int = 2,
) -> DataFrame:
    """One row per row of df: its id as _id and `secrets`, an array of
    (start, end, kind, value_sha256, n_repos, n_owners, live), by start and kind.

    A free candidate that overlaps a span of a fixed kind, or that more than
    `max_owners` owners hold, is no secret. Values leave the operator as hashes.
    """
    found = candidates(df, id_col, text_col, repo_col, owner_col)
    fixed = F.concat(*[F.coalesce(F.col(k), F.array()) for k in KINDS[:3]])
    free = F.filter("free", lambda s: ~F.exists(fixed, lambda x: (x["start"] < s["end"]) & (s["start"] < x["end"])))

    def tag(kind: str) -> Column:
        return F.transform(
            F.coalesce(free if kind == "free" else F.col(kind), F.array()),
            lambda s: F.struct(
                s["start"].alias("start"), s["end"].alias("end"), F.lit(KINDS.index(kind)).alias("order"),
                F.sha2(s["value"], 256).alias("value_sha256"),
            ),
        )

    tagged = [tag(kind) for kind in KINDS]
    each = common.written(
        found.select("_row", "_repo", "_owner", F.explode(F.concat(*tagged)).alias("s")).select(
            "_row", "_repo", "_owner", "s.*"
        )
    )
    # Copies within a repository and an owner are merged before anything meets by value.
    owners = (
        each.groupBy("value_sha256", "_owner", "_repo").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("value_sha256", "_owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
        .groupBy("value_sha256").agg(
            F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("_n")
        )
    )
    known = common.join_counted(each, common.written(owners), ["value_sha256"], "_n").withColumn(
        "live", F.col("n_owners") <= max_owners
    )
    per_row = (
        known.filter((F.col("order") < 3) | F.col("live"))
        .groupBy("_row")
        .agg(F.sort_array(F.collect_list(F.struct("start", "order", "end", "value_sha256", "n_repos", "n_owners", "live"))).alias("_s"))
    )
    kind = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["order"] + 1)
    return found.select("_row", "_id").join(per_row, "_row", "left").select(
        "_id",
        F.transform(
            F.coalesce("_s", F.array()),
            lambda s: F.struct(
                s["start"].alias("start"), s["end"].alias("end"), kind(s).alias("kind"),
                s["value_sha256"].alias("value_sha256"), s["n_repos"].alias("n_repos"),
                s["n_owners"].alias("n_owners"), s["live"].alias("live"),
            ),
        ).alias("secrets"),
    )
