"""The theme registry: assignment, discovery and lifecycle.

``assign_exact`` replays the order-dependent rule (each assignment moves the centroid before the next, in
trace-id order), sequentially within a scope and in parallel over scopes. ``assign_frozen`` compares with the
centroids as they stand at the start and folds all members in at the end: relational, and the form for
scopes too large for one task.
"""

from __future__ import annotations

from datetime import datetime, timezone

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..schemas import ASSIGNMENT, THEME, columns
from ..session import checkpointed, ship
from . import cluster, stats

ASSIGN_THRESHOLD = 0.72
MAX_EXEMPLARS = 5
ACTIVATE_AFTER = 10
SCOPE = ["agent_id", "facet"]


def next_state(state: str, members: int, activate_after: int = ACTIVATE_AFTER) -> str:
    if state == "resolved":
        return "regressed"
    return "active" if state == "new" and members >= activate_after else state


def next_state_column(state: Column, members: Column, added: Column, activate_after: int = ACTIVATE_AFTER) -> Column:
    return F.when((state == "resolved") & (added > 0), "regressed").when((state == "new") & (members >= activate_after) & (added > 0), "active").otherwise(state)


_EVENT = f"kind string, {ASSIGNMENT}, {', '.join(f't_{c.strip()}' for c in THEME.split(', '))}, was string"


def assign_exact(pool: DataFrame, themes: DataFrame, now: datetime, threshold: float = ASSIGN_THRESHOLD, activate_after: int = ACTIVATE_AFTER, max_exemplars: int = MAX_EXEMPLARS) -> DataFrame:
    """One pass over each (agent, facet), as rows of two kinds: ``assignment``, and changed ``theme``.

    ``pool(trace_id, agent_id, facet, embedding, window)``. All themes are candidates, resolved and muted
    ones too. Below the threshold a residual row keeps the best similarity. Write the result before
    splitting it, so that the pass runs once.
    """
    ship(pool.sparkSession)
    stamp = pd.Timestamp(now.astimezone(timezone.utc).replace(tzinfo=None))
    theme_columns = columns(THEME)

    def run(items: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        out = []
        rows = known.sort_values("id").to_dict("records")
        for t in rows:
            t["centroid"], t["exemplar_trace_ids"], t["was"] = np.asarray(t["centroid"], np.float64), list(t["exemplar_trace_ids"] if t["exemplar_trace_ids"] is not None else []), t["state"]
        matrix = np.array([t["centroid"] for t in rows], np.float64).reshape(len(rows), -1)
        sizes = np.linalg.norm(matrix, axis=1) if len(rows) else np.empty(0)
        touched = set()
        for item in items.sort_values("trace_id").itertuples(index=False):
            v = np.asarray(item.embedding, np.float64)
            best, at = 0.0, -1
            if len(rows):
                if len(v) != matrix.shape[1]:
                    raise ValueError(f"vectors differ in size: {len(v)} and {matrix.shape[1]}")
                scale = sizes * np.linalg.norm(v)
                sims = np.clip(np.divide(matrix @ v, scale, out=np.zeros(len(rows)), where=scale > 0), -1.0, 1.0)
                at = int(sims.argmax())
                best = float(sims[at])
            hit = at >= 0 and best >= threshold
            base = {"kind": "assignment", "trace_id": item.trace_id, "agent_id": item.agent_id, "facet": item.facet, "theme_id": rows[at]["id"] if hit else None, "similarity": best, "window": item.window}
            out.append(base)
            if not hit:
                continue
            t = rows[at]
            n = int(t["member_count"])
            matrix[at] = v if n == 0 else (matrix[at] * n + v) / (n + 1)
            sizes[at] = np.linalg.norm(matrix[at])
            first = t["first_window"]
            t.update(member_count=n + 1, state=next_state(t["state"], n + 1, activate_after), last_seen_window=item.window, first_window=item.window if not isinstance(first, str) else min(first, item.window), updated_at=stamp)
            if len(t["exemplar_trace_ids"]) < max_exemplars:
                t["exemplar_trace_ids"].append(item.trace_id)
            touched.add(at)
        for at in sorted(touched):
            t = rows[at]
            t["centroid"] = matrix[at].tolist()
            out.append({"kind": "theme", "was": t["was"], **{f"t_{c}": t[c] for c in theme_columns}})
        names = ["kind", *columns(ASSIGNMENT), *(f"t_{c}" for c in theme_columns), "was"]
        frame = pd.DataFrame(out, columns=names).astype(object)
        return frame.where(frame.notna(), None)

    left = pool.select("trace_id", "agent_id", "facet", V.as_double(F.col("embedding")).alias("embedding"), "window")
    return left.groupBy(*SCOPE).cogroup(themes.select(*theme_columns).groupBy(*SCOPE)).applyInPandas(run, _EVENT)


def assignments_of(events: DataFrame) -> DataFrame:
    return events.where("kind = 'assignment'").select(*columns(ASSIGNMENT))


def themes_of(events: DataFrame) -> DataFrame:
    return events.where("kind = 'theme'").select(*[F.col(f"t_{c}").alias(c) for c in columns(THEME)])


def transitions_of(events: DataFrame) -> DataFrame:
    return events.where("kind = 'theme' and was <> t_state").select(F.col("t_id").alias("theme_id"), F.col("was").alias("from_state"), F.col("t_state").alias("to_state"), F.col("t_agent_id").alias("agent_id"), F.col("t_facet").alias("facet"))


def assign_frozen(pool: DataFrame, themes: DataFrame, threshold: float = ASSIGN_THRESHOLD) -> DataFrame:
    """Assignments against the centroids as they stand; every pool row gets one, residual below the threshold."""
    items = pool.select("trace_id", "agent_id", "facet", "window", V.as_double(F.col("embedding")).alias("vector"))
    known = themes.select("agent_id", "facet", F.col("id").alias("theme_id"), "centroid")
    best = V.nearest(items.select("trace_id", *SCOPE, "vector"), known, "trace_id", SCOPE)
    joined = items.select("trace_id", *SCOPE, "window").join(best, ["trace_id", *SCOPE], "left")
    similarity = F.coalesce("similarity", F.lit(0.0))
    return joined.select("trace_id", *SCOPE, F.when(similarity >= threshold, F.col("theme_id")).alias("theme_id"), similarity.alias("similarity"), "window")


def fold_frozen(themes: DataFrame, pool: DataFrame, assigned: DataFrame, now: datetime, activate_after: int = ACTIVATE_AFTER, max_exemplars: int = MAX_EXEMPLARS) -> DataFrame:
    """Themes after a frozen batch: every field in its batch form."""
    hits = assigned.where("theme_id is not null")
    vectors = hits.join(pool.select("trace_id", "facet", V.as_double(F.col("embedding")).alias("v")), ["trace_id", "facet"])
    totals = V.mean_vectors(vectors, ["theme_id"], "v", "total", total=True)
    facts = hits.groupBy("theme_id").agg(F.count("*").cast("int").alias("added"), F.min("window").alias("least"), F.max_by("window", "trace_id").alias("last"))
    order = Window.partitionBy("theme_id").orderBy("trace_id")
    firsts = hits.withColumn("p", F.row_number().over(order)).where(F.col("p") <= max_exemplars).groupBy("theme_id").agg(F.array_sort(F.collect_list("trace_id")).alias("fresh"))
    joined = themes.join(facts.join(totals, "theme_id").join(firsts, "theme_id").withColumnRenamed("theme_id", "id"), "id", "left")
    added = F.coalesce("added", F.lit(0))
    members = (F.col("member_count") + added).cast("int")
    room = F.greatest(F.lit(max_exemplars) - F.size("exemplar_trace_ids"), F.lit(0))
    own = {
        "centroid": F.when(added > 0, V.fold_centroid(F.col("centroid"), F.col("member_count"), F.col("total"), added)).otherwise(F.col("centroid")),
        "member_count": members,
        "state": next_state_column(F.col("state"), members, added, activate_after),
        "exemplar_trace_ids": F.when(added > 0, F.concat("exemplar_trace_ids", F.slice("fresh", 1, room))).otherwise(F.col("exemplar_trace_ids")),
        "first_window": F.least("first_window", "least"),
        "last_seen_window": F.coalesce("last", "last_seen_window"),
        "updated_at": F.when(added > 0, F.lit(now)).otherwise(F.col("updated_at")),
    }
    return joined.select(*[own.get(c, F.col(c)).alias(c) for c in columns(THEME)])


def discover(pool: DataFrame, labels: DataFrame | None, first_number: int, now: datetime, threshold: float = cluster.MERGE_THRESHOLD, least: int = cluster.MIN_CLUSTER_SIZE, activate_after: int = ACTIVATE_AFTER, max_exemplars: int = MAX_EXEMPLARS, facet_order: list[str] | None = None, prefix: str = "T-") -> tuple[DataFrame, DataFrame]:
    """New themes of each scope, and assignments of all members and noise.

    ``labels(agent_id, facet, cluster, label, description)`` names clusters; without it the members'
    commonest summary does. Theme numbers follow agent, facet order, size and first member.
    """
    items = pool.select(*SCOPE, F.col("trace_id").alias("id"), V.as_double(F.col("embedding")).alias("vector"))
    found = checkpointed(cluster.discover(items, SCOPE, threshold, least))
    members = pool.join(found.withColumnRenamed("id", "trace_id").where("cluster is not null"), [*SCOPE, "trace_id"])
    centers = V.mean_vectors(members, [*SCOPE, "cluster"], "embedding")
    facts = members.groupBy(*SCOPE, "cluster").agg(F.count("*").cast("int").alias("member_count"), F.min("window").alias("first_window"), F.max("window").alias("last_seen_window"))
    rank = F.coalesce(F.array_position(F.lit(facet_order), F.col("facet")), F.lit(0)) if facet_order else F.lit(0)
    numbered = facts.withColumn("number", F.row_number().over(Window.orderBy("agent_id", rank, "facet", F.desc("member_count"), "cluster")) + (first_number - 1))
    if labels is None:
        labels = stub_labels(members)
    named = numbered.join(centers, [*SCOPE, "cluster"]).join(labels, [*SCOPE, "cluster"], "left").withColumn("id", F.concat(F.lit(prefix), F.col("number").cast("string")))
    named = checkpointed(named)
    scored = members.join(named.select(*SCOPE, "cluster", F.col("id").alias("theme_id"), "centroid"), [*SCOPE, "cluster"])
    assigned = scored.select("trace_id", *SCOPE, "theme_id", V.cosine(V.as_double(F.col("embedding")), F.col("centroid")).alias("similarity"), "window")
    listed = stats.exemplar_lists(assigned, max_exemplars).withColumnRenamed("theme_id", "id")
    themes = named.join(listed, "id").select(
        "id", *SCOPE, F.coalesce("label", F.lit("unlabeled theme")).alias("label"), F.coalesce("description", F.lit("")).alias("description"), F.when(F.col("member_count") >= activate_after, "active").otherwise("new").alias("state"), "centroid", "member_count", "exemplar_trace_ids", F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"), "first_window", "last_seen_window", F.lit(None).cast("string").alias("note")
    )
    noise = pool.join(found.where("cluster is null").select(*SCOPE, F.col("id").alias("trace_id")), [*SCOPE, "trace_id"], "left_semi")
    rest = assign_frozen(noise, themes, 2.0)
    return themes.select(*columns(THEME)), assigned.unionByName(rest).select(*columns(ASSIGNMENT))


def stub_labels(members: DataFrame) -> DataFrame:
    """Each cluster's commonest summary, ties to the one seen first by trace id, at most 60 characters."""
    counted = members.groupBy(*SCOPE, "cluster", "summary").agg(F.count("*").alias("n"), F.min("trace_id").alias("seen"))
    order = Window.partitionBy(*SCOPE, "cluster").orderBy(F.desc("n"), "seen")
    top = counted.withColumn("r", F.row_number().over(order)).where("r = 1")
    label = F.when(F.length("summary") > 60, F.concat(F.left("summary", F.lit(57)), F.lit("..."))).otherwise(F.coalesce("summary", F.lit("unlabeled theme")))
    return top.select(*SCOPE, "cluster", label.alias("label"), F.concat(F.lit("traces whose "), F.col("facet"), F.lit(" resembles: "), label).alias("description"))


def changed(themes: DataFrame, ids: list[str], now: datetime, **fields: str | None) -> DataFrame:
    """New versions of some themes; an unknown id is an error."""
    found = themes.where(F.col("id").isin(ids))
    missing = sorted(set(ids) - {r.id for r in found.select("id").collect()})
    if missing:
        raise KeyError(f"no such theme: {', '.join(missing)}")
    own = {**{k: F.lit(v).cast("string") for k, v in fields.items()}, "updated_at": F.lit(now)}
    return found.select(*[own.get(c, F.col(c)).alias(c) for c in columns(THEME)])


def resolve(themes: DataFrame, theme_id: str, now: datetime, note: str | None = None) -> DataFrame:
    return changed(themes, [theme_id], now, state="resolved", **({"note": note} if note is not None else {}))


def mute(themes: DataFrame, theme_id: str, now: datetime, note: str | None = None) -> DataFrame:
    return changed(themes, [theme_id], now, state="muted", **({"note": note} if note is not None else {}))


def reopen(themes: DataFrame, theme_id: str, now: datetime) -> DataFrame:
    return changed(themes, [theme_id], now, state="active", note=None)


def relabel(themes: DataFrame, theme_id: str, now: datetime, label: str, description: str | None = None) -> DataFrame:
    if not label.strip():
        raise ValueError("a label can't be blank")
    return changed(themes, [theme_id], now, label=label, **({"description": description} if description is not None else {}))


def sweep(assignments: DataFrame, themes: DataFrame, k: int, now: datetime) -> DataFrame:
    """New versions of the open themes that the last ``k`` windows don't hold: resolved, with a note."""
    quiet = stats.empty_windows(assignments, themes, k)
    own = {"state": F.lit("resolved"), "note": F.lit(f"auto-resolved after {k} empty windows"), "updated_at": F.lit(now)}
    return themes.join(quiet, "id", "left_semi").select(*[own.get(c, F.col(c)).alias(c) for c in columns(THEME)])


def refresh_exemplars(themes: DataFrame, assignments: DataFrame, ids: DataFrame, k: int = MAX_EXEMPLARS) -> DataFrame:
    """``themes`` with fresh exemplars for the ids given; a theme without traces keeps its own."""
    listed = stats.exemplar_lists(assignments, k).join(ids.withColumnRenamed("id", "theme_id"), "theme_id", "left_semi").withColumnsRenamed({"theme_id": "id", "exemplar_trace_ids": "_x"})
    own = {"exemplar_trace_ids": F.coalesce("_x", "exemplar_trace_ids")}
    return themes.join(listed, "id", "left").select(*[own.get(c, F.col(c)).alias(c) for c in columns(THEME)])
