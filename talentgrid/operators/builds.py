"""Restartable builds of the role catalogue.

A catalogue is a folder:

* ``data/<build>/wave=<k>/bucket=<b>``: rows of buckets (a hash of role_id), each bucket as one sorted
  file; never changed once written;
* ``manifests/<n>``: which folder holds each bucket.  The greatest finished manifest is the
  catalogue: readers see the state before a build or after it, nothing between;
* ``failures``: role ids whose ranking failed, for a later retry.

A build compares digests of its inputs with those stored, row by row, and writes anew only buckets
with a role that is new, changed or gone; rows of such a bucket that did not change are copied, not
computed.  It writes in waves of buckets.  A build is named by what it has to do, so one that was
stopped and is started again on the same inputs finds its finished waves and goes on after them;
half a wave is written over.  The manifest comes last.  One build runs at a time.

A role whose ranking fails keeps the one it had.  Columns of vectors are counted while they are
written (missing, of another size, not of length one); the counts come with the report, and
``strict`` makes them stop the build before its manifest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..scratch import cut
from ..sources import store
from ..sources.tables import id_list
from .catalog import SORT_SKILLS, ranked_skills
from .profiles import role_texts

#: Rows of a bucket, about, at the first build; jobs of a build, each of which is lost at most when it stops.
BUCKET_ROWS, WAVES = 50_000, 4
VECTORS = ("capability_vector", "intent_vector")
TEXT_INPUTS = ("title", "description", "skills", "certifications", "raw_certifications", "domain_tags", *VECTORS)
RANK_INPUTS = ("title", "description", "raw_skills", "reply", "vector")
STATE = (
    "role_id long, text_digest string, rank_digest string, capability_text string, intent_text string, "
    + "".join(f"{v} array<float>, " for v in VECTORS)
    + "processed_job_title string, sort_skills string, processed_skills string, failed boolean, build int"
)
MANIFEST = "number int, buckets int, bucket int, folder string, rows long"


def listed_skills(sort_skills: Column) -> Column:
    """Skills, domains and scores of a ``sort_skills`` JSON column; what is no such list is empty."""
    return F.filter(F.coalesce(F.from_json(sort_skills, SORT_SKILLS), F.array().cast(SORT_SKILLS)), lambda x: x.isNotNull())


def skill_rows(state: DataFrame) -> DataFrame:
    """(role_id, skill, domain, score, ord) of every listed skill of a catalogue, from its JSON column."""
    return state.select("role_id", F.posexplode(listed_skills(F.col("sort_skills"))).alias("ord", "x")).select("role_id", "x.*", (F.col("ord") + 1).alias("ord"))


def vector_counts(columns: tuple[str, ...], size: int) -> list[Column]:
    """Counts of missing, wrong-sized and non-unit vectors of each column, as ``<column>_<what>``."""
    out = []
    for c in columns:
        norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        right = F.coalesce(F.size(c) == size, F.lit(False))
        out += [F.count_if(F.col(c).isNull()).alias(f"{c}_missing"), F.count_if(F.col(c).isNotNull() & ~right).alias(f"{c}_wrong_size"), F.count_if(right & ~F.coalesce(F.abs(norm - 1) <= 1e-3, F.lit(False))).alias(f"{c}_not_unit")]
    return out


class Catalogue:
    """The role catalogue in one folder."""

    def __init__(self, spark: SparkSession, root: str, vector_size: int = 64):
        self.spark, self.root, self.vector_size = spark, root.rstrip("/"), vector_size

    def manifest(self) -> list:
        """Rows of the last finished manifest, one for each bucket."""
        done = [int(n) for n in store.children(self.spark, f"{self.root}/manifests") if n.isdigit() and store.finished(self.spark, f"{self.root}/manifests/{n}")]
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/{max(done)}").orderBy("bucket").collect() if done else []

    def state(self) -> DataFrame:
        """All roles, as the last finished build left them."""
        folders = [f"{self.root}/{r['folder']}" for r in self.manifest() if r["folder"]]
        read = self.spark.read.schema(STATE)
        return read.parquet(*folders) if folders else self.spark.createDataFrame([], STATE)

    def failed(self) -> DataFrame:
        """Ids of roles that the last build could not rank."""
        path = f"{self.root}/failures"
        return id_list(self.spark, path) if store.exists(self.spark, path) else self.spark.createDataFrame([], "role_id long")

    def changes(self, inputs: DataFrame, rerank: bool = False, ids: DataFrame | None = None, limit: int | None = None, version: str = "") -> DataFrame:
        """(role_id, text_digest, rank_digest, status): what a build would do with every role.

        Status: new, changed, same, gone (no longer in the inputs), or skipped: not among ``ids``,
        not of the first ``limit`` ids, or, with ``rerank``, not in the catalogue yet.  Only a build
        of all roles finds any gone.  ``version`` is part of the digests: another one makes all changed.
        """
        asked = inputs if ids is None else inputs.join(ids.select("role_id").distinct(), "role_id", "left_semi")
        asked = asked if limit is None else asked.orderBy("role_id").limit(limit)
        digest = lambda names: F.sha2(F.to_json(F.struct(F.lit(version).alias("version"), *names)), 256)
        new = asked.select("role_id", digest(TEXT_INPUTS).alias("new_text"), digest(RANK_INPUTS).alias("new_rank"), F.lit(True).alias("asked"))
        old = self.state().select("role_id", "text_digest", "rank_digest", F.lit(True).alias("known"))
        both = old.join(new, "role_id", "full_outer")
        whole = ids is None and limit is None and not rerank
        equal = (F.col("rank_digest") == F.col("new_rank")) & (F.lit(rerank) | (F.col("text_digest") == F.col("new_text")))
        status = (
            F.when(F.col("asked").isNull(), "gone" if whole else "skipped")
            .when(F.col("known").isNull(), "skipped" if rerank else "new")
            .when(equal, "same")
            .otherwise("changed")
        )
        text = F.col("text_digest") if rerank else F.coalesce("new_text", "text_digest")
        return both.select("role_id", text.alias("text_digest"), F.coalesce("new_rank", "rank_digest").alias("rank_digest"), status.alias("status"), F.col("known").isNotNull().alias("known"))

    def rows(self, changes: DataFrame, inputs: DataFrame, vectors: DataFrame, rerank: bool, number: int) -> DataFrame:
        """The new rows of the buckets of ``changes``."""
        state = self.state()
        kept = state.join(changes.filter("status in ('same', 'skipped')").select("role_id"), "role_id", "left_semi")
        todo = changes.filter("status in ('new', 'changed')").select("role_id", F.col("text_digest").alias("_text"), F.col("rank_digest").alias("_rank"))
        source = inputs.join(todo, "role_id")
        able, aim = role_texts(*[F.col(c) for c in ("title", "description", "skills", "certifications", "raw_certifications", "domain_tags")])
        texts = source.select("role_id", "_text", "_rank", able.alias("_able"), aim.alias("_aim"), *[F.col(v).alias(f"_{v}") for v in VECTORS])
        ranked = ranked_skills(source.select("role_id", "raw_skills", "reply", "vector"), vectors)
        json = lambda c: F.to_json(F.col(c))
        ranked = ranked.select("role_id", F.col("processed_title").alias("_title"), json("sort_skills").alias("_sort"), json("processed_skills").alias("_processed"), F.col("failed").alias("_failed"))
        old = state.drop("build").withColumn("_known", F.lit(True))
        both = texts.join(ranked, "role_id").join(old, "role_id", "left")
        fresh = lambda new, was: F.col(was) if rerank else F.col(new)
        rank = lambda new, was, none: F.when(~F.col("_failed"), F.col(new)).otherwise(F.coalesce(was, F.lit(none)))
        made = both.select(
            "role_id",
            F.col("_text").alias("text_digest"),
            F.col("_rank").alias("rank_digest"),
            fresh("_able", "capability_text").alias("capability_text"),
            fresh("_aim", "intent_text").alias("intent_text"),
            *[fresh(f"_{v}", v).cast("array<float>").alias(v) for v in VECTORS],
            rank("_title", "processed_job_title", None).alias("processed_job_title"),
            rank("_sort", "sort_skills", "[]").alias("sort_skills"),
            rank("_processed", "processed_skills", "[]").alias("processed_skills"),
            F.col("_failed").alias("failed"),
            F.lit(number).alias("build"),
        )
        return kept.unionByName(made)

    def build(
        self,
        inputs: DataFrame,
        vectors: DataFrame,
        rerank: bool = False,
        ids: DataFrame | None = None,
        limit: int | None = None,
        dry_run: bool = False,
        strict: bool = False,
        version: str = "",
        waves: int = WAVES,
        after_wave: Callable[[int], None] | None = None,
    ) -> dict[str, int]:
        """Bring the catalogue to the state of ``inputs``; the counts of what was done.

        ``inputs``: role_id, ``TEXT_INPUTS`` and ``RANK_INPUTS``, one row for each role; ``vectors``: as in
        ``catalog.ranked_skills``.  ``rerank`` leaves texts and their vectors as they are.  A dry
        run counts only and writes nothing.  ``after_wave`` is called with the number of each
        wave that was written.
        """
        before = self.manifest()
        number = before[0]["number"] + 1 if before else 1
        changes = self.changes(inputs, rerank, ids, limit, version)
        if not dry_run:
            changes = cut(changes, "changes")
        count = {r["status"]: r["n"] for r in changes.groupBy("status").agg(F.count("*").alias("n")).collect()}
        report = {s: count.get(s, 0) for s in ("new", "changed", "same", "gone", "skipped")}
        if dry_run:
            return report | {"build": number - 1, "buckets": 0, "rows": 0, "waves": 0}
        buckets = before[0]["buckets"] if before else max(1, -(-sum(report.values()) // BUCKET_ROWS))
        if before and (before[0]["buckets"] * 8 * BUCKET_ROWS < sum(report.values())):
            raise ValueError("the catalogue has outgrown its buckets: build it into a new folder")
        changes = changes.withColumn("bucket", F.pmod(F.xxhash64("role_id"), F.lit(buckets)).cast("int"))
        of = F.struct("role_id", "text_digest", "rank_digest", "status")
        touched = F.col("status").isin("new", "changed", "gone")
        per = changes.groupBy("bucket").agg(F.count_if(touched).alias("touched"), F.count_if((F.col("status") != "gone") & ((F.col("status") != "skipped") | F.col("known"))).alias("rows"), F.sum(F.when(touched, F.xxhash64(of)).cast("decimal(38,0)")).cast("string").alias("key"))
        per = per.filter("touched > 0").orderBy("bucket").collect()  # one row for each bucket
        found = dict.fromkeys([f"{v}_{w}" for v in VECTORS for w in ("missing", "wrong_size", "not_unit")], 0)
        if not per:
            return report | found | {"build": number - 1, "buckets": 0, "rows": 0, "waves": 0}
        name = self.spark.range(1).select(F.sha2(F.lit(repr((number, rerank, waves, [(r["bucket"], r["key"]) for r in per]))), 256).alias("name")).first()[0][:32]
        written = 0
        for wave in range(min(waves, len(per))):
            own = [r["bucket"] for r in per[wave::waves]]
            folder = f"{self.root}/data/{name}/wave={wave}"
            counts = vector_counts(VECTORS, self.vector_size)
            if store.finished(self.spark, folder):
                seen = self.spark.read.schema(STATE).parquet(folder).agg(*counts).first().asDict() if any(r["rows"] for r in per[wave::waves]) else found
            else:
                seen = Observation()
                rows = self.rows(changes.filter(F.col("bucket").isin(own)), inputs, vectors, rerank, number).observe(seen, *counts)
                rows = rows.withColumn("bucket", F.pmod(F.xxhash64("role_id"), F.lit(buckets)).cast("int"))
                rows.repartition(len(own), "bucket").sortWithinPartitions("bucket", "role_id").write.mode("overwrite").partitionBy("bucket").parquet(folder)
                seen, written = seen.get, written + 1
                if after_wave:
                    after_wave(wave)
            found = {k: v + (seen.get(k) or 0) for k, v in found.items()}
        if strict and any(found.values()):
            raise ValueError(f"vectors break their constraints: { {k: v for k, v in found.items() if v} }")
        where = {r["bucket"]: (r["folder"], r["rows"]) for r in before if r["folder"]}
        for k, r in enumerate(per):
            where[r["bucket"]] = (f"data/{name}/wave={k % waves}/bucket={r['bucket']}", r["rows"])
        rows = [(number, buckets, b, f, n) for b, (f, n) in where.items() if n] or [(number, buckets, None, None, 0)]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifests/{number}")
        self._list_failures()
        return report | found | {"build": number, "buckets": len(per), "rows": sum(r["rows"] for r in per), "waves": written}

    def _list_failures(self) -> None:
        path = f"{self.root}/failures"
        failed = self.state().filter("failed").select("role_id")
        if failed.isEmpty():
            store.remove(self.spark, path)
        else:
            failed.orderBy("role_id").select(F.col("role_id").cast("string")).write.mode("overwrite").text(path)

    def retry(self, inputs: DataFrame, vectors: DataFrame, **more) -> dict[str, int] | None:
        """Rank anew the roles of the failure list; None if there is no such list."""
        if not store.exists(self.spark, f"{self.root}/failures"):
            return None
        return self.build(inputs, vectors, rerank=True, ids=cut(self.failed(), "retry"), **more)

    def samples(self, inputs: DataFrame, n: int = 3) -> DataFrame:
        """(role_id, capability_text, intent_text, raw_skills) of the first ``n`` roles: what a dry run shows."""
        able, aim = role_texts(*[F.col(c) for c in ("title", "description", "skills", "certifications", "raw_certifications", "domain_tags")])
        return inputs.orderBy("role_id").limit(n).select("role_id", able.alias("capability_text"), aim.alias("intent_text"), "raw_skills")

    def vacuum(self) -> list[str]:
        """Delete builds that the last manifest does not name, and older manifests; the names of both."""
        now = self.manifest()
        used = {r["folder"].split("/")[1] for r in now if r["folder"]}
        gone = [f"data/{n}" for n in store.children(self.spark, f"{self.root}/data") if n not in used]
        gone += [f"manifests/{n}" for n in store.children(self.spark, f"{self.root}/manifests") if now and n != str(now[0]["number"])]
        for path in gone:
            store.remove(self.spark, f"{self.root}/{path}")
        return gone
