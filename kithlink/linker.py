"""``Linker``: one loaded store and every stage over it, with frames in and out."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from kithlink.diagnostics import columns, coverage, draft, ladders
from kithlink.operators import cluster as clustering
from kithlink.operators import estimate as estimation
from kithlink.operators import explain as explaining
from kithlink.operators import predict as prediction
from kithlink.operators import search as searching
from kithlink.plans.model import Model
from kithlink.plans.schema import Schema
from kithlink.sources import sample
from kithlink.sources.store import Store, load


class Linker:
    """Deduplicate one input or link several.

    ``data`` is a frame or path, a list of them, or a dict by name; ``mode`` is dedup, link-and-dedup or link (the default over several inputs);
    ``all_pairs`` replaces the schema's blocking by the source that selects on nothing.
    """

    def __init__(self, spark: SparkSession, schema: Schema | str | dict, data, mode: str | None = None, all_pairs: bool = False):
        if not isinstance(schema, Schema):
            schema = Schema.parse(schema) if isinstance(schema, dict) or schema.lstrip().startswith("{") else Schema.load(schema)
        self.spark, self.all_pairs = spark, all_pairs
        self.store: Store = load(spark, data, schema, mode)
        self.schema = self.store.schema
        self.last_report = self.last_predictions = self.last_clusters = self.last_quality = self.last_truth = None
        self.last_truncated = False

    @property
    def records(self) -> int:
        return self.store.records

    @property
    def mode(self) -> str:
        return self.store.mode

    @cached_property
    def ties(self) -> list[tuple[str, str, str]]:
        """Column pairs whose measured evidence ties them."""
        return columns.ties_for_estimation(self.store)

    def truth(self, source) -> DataFrame:
        """Known pairs as rows, from a csv or parquet path or a frame with id_a and id_b."""
        table = source if isinstance(source, DataFrame) else self.spark.read.option("header", True).csv(source) if str(source).endswith(".csv") else self.spark.read.parquet(source)
        found, self.last_truth = clustering.resolve_ids(self.store, table)  # what was missing or ambiguous is counted there
        return found.select("row_a", "row_b")

    def estimate(self, out: str | None = None, options: estimation.EstimateOptions | None = None, **settings) -> tuple[Model, estimation.EstimateReport]:
        options = options or estimation.EstimateOptions(**settings)
        model, self.last_report = estimation.estimate(self.store, options, self.all_pairs, self.ties if options.tie_holdout else [])
        if out:
            model.save(out)
        return model, self.last_report

    def predict(self, model: Model | str, out: str | None = None, threshold: float | None = None, probability: float | None = None, limit: int = 0, form: str | None = None, **options) -> DataFrame:
        """Predictions; with a limit, ``last_truncated`` says whether there were more."""
        found = prediction.predict(self.store, _model(model), threshold, probability, all_pairs=self.all_pairs, **options)
        found, self.last_truncated = prediction.truncated(found, limit) if limit else (found, False)
        if out:
            prediction.write_edges(found, out, form)
        self.last_predictions = found
        return found

    def plan(self, model: Model | str, **options) -> prediction.PlanReport:
        return prediction.plan(self.store, _model(model), all_pairs=self.all_pairs, **options)

    def zones(self, model: Model | str, **options) -> DataFrame:
        return prediction.zones(self.store, _model(model), all_pairs=self.all_pairs, **options)

    def rescore(self, model: Model | str, spill: str, out: str | None = None, **options) -> DataFrame:
        found, self.last_warnings = prediction.rescore(self.store, _model(model), spill, **options)
        if out:
            prediction.write_edges(found, out)
        return found

    def cluster(self, predictions=None, out: str | None = None, truth=None, **options) -> DataFrame:
        found = clustering.cluster(self.store, self.last_predictions if predictions is None else predictions, **options)
        if out:
            prediction._single(found.drop("row"), out, "csv" if out.endswith(".csv") else "parquet") if out.endswith((".csv", ".parquet", ".pq")) else found.drop("row").write.mode("overwrite").parquet(out)
        if truth is not None:
            self.last_quality = clustering.quality(found, self.truth(truth))
        self.last_clusters = found
        return found

    def row_of(self, identity: str) -> int:
        """The row of an id (``dataset:id`` where inputs share ids)."""
        pair = self.spark.createDataFrame([(identity, identity)], "id_a string, id_b string")
        found, state = clustering.resolve_ids(self.store, pair)
        if not state.resolved:
            raise KeyError(f"{identity!r} is {'ambiguous' if state.ambiguous else 'missing'}")
        return found.first().row_a

    def explain(self, a, b, model: Model | str | None = None, by_row: bool = False, **options) -> dict:
        rows = (int(a), int(b)) if by_row else (self.row_of(str(a)), self.row_of(str(b)))
        return explaining.explain_rows(self.store, *rows, _model(model) if model is not None else None, **options)

    def waterfalls(self, model: Model | str, pairs: DataFrame, **options) -> DataFrame:
        pairs = pairs if "row_a" in pairs.columns else clustering.resolve_ids(self.store, pairs)[0]
        return explaining.waterfalls(self.store, _model(model), pairs, **options)

    def search(self, record, model: Model | str, k: int = 10, **options) -> DataFrame:
        return searching.search(self.store, record, _model(model), k, **options)

    def inspect(self) -> DataFrame:
        return columns.inspect(self.store)

    def profile(self, truth=None, **options) -> columns.Profile:
        return columns.profile(self.store, truth=None if truth is None else self.truth(truth), **options)

    def explain_blocking(self, count: bool = False) -> coverage.BlockingReport:
        return coverage.explain_blocking(self.store, self.all_pairs, count)

    def recall(self, truth, **options) -> coverage.Recall:
        return coverage.recall(self.store, self.truth(truth), self.all_pairs, **options)

    def completeness(self, model: Model | str, **options) -> coverage.Completeness:
        return coverage.completeness(self.store, _model(model), self.all_pairs, **options)

    def levels(self, truth=None, **options) -> tuple[list[ladders.LadderAdvice], Schema]:
        return ladders.advise_levels(self.store, None if truth is None else self.truth(truth), **options)

    def simplify(self, model: Model | str, **options) -> tuple[list[ladders.Merge], Schema | None]:
        return ladders.simplify(self.store, _model(model), all_pairs=self.all_pairs, **options)


def _model(model: Model | str) -> Model:
    return model if isinstance(model, Model) else Model.load(model)


def cluster_file(spark: SparkSession, schema: Schema, data, predictions: str, **options) -> DataFrame:
    """Cluster a file of predictions with only the ids loaded."""
    return clustering.cluster(load(spark, data, schema, ids_only=True), predictions, **options)


gen_sample = sample.people
gen_two = sample.two_inputs
init = draft.draft
merge_predictions = prediction.merge_predictions
__all__ = ["Linker", "cluster_file", "gen_sample", "gen_two", "init", "merge_predictions"]
