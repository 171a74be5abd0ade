"""The update of a corpus and its model by micro-batches: unseen rows, online step, drift, refit, state."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from sourceweave import shared
from sourceweave.operators import dedup
from sourceweave.streaming import model as topic_model
from sourceweave.streaming.model import TopicModel


class Updater:
    """Folds batches (order, two keys, text, vector) into a corpus and a model kept under ``path``.

    :meth:`fold` is what ``foreachBatch`` calls. A batch is skipped if its number is not larger than the last one folded,
    so a batch that is run again after a failure is folded once.
    """

    def __init__(self, path: str, keys: tuple[str, str] = ("url", "title"), order: str = "ord", text: str = "text", vector: str = "embedding", stop: tuple[str, ...] = ()) -> None:
        self.path, self.keys, self.order, self.text, self.vector, self.stop = path.rstrip("/"), keys, order, text, vector, stop

    def corpus(self, spark: SparkSession) -> DataFrame | None:
        """All rows folded so far with their public topic, None before the first."""
        parts = self._parts(spark)
        return spark.read.parquet(*parts) if parts else None

    def model(self, spark: SparkSession) -> TopicModel | None:
        """The model as of the last batch folded."""
        parts = self._parts(spark)
        return topic_model.load(spark, self._model_path(parts[-1])) if parts else None

    def _model_path(self, part: str) -> str:
        return f"{self.path}/model/{part.rsplit('/', 1)[1]}"

    def _parts(self, spark: SparkSession) -> list[str]:
        """Of the parts written whole the newest full one and all later ones."""
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/corpus")
        files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(root):
            return []
        parts = sorted(str(s.getPath()) for s in files.listStatus(root) if files.exists(jvm.org.apache.hadoop.fs.Path(f"{s.getPath()}/_SUCCESS")))
        return parts[max((i for i, p in enumerate(parts) if p.endswith("-full")), default=0) :]

    def fold(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        parts = self._parts(spark)
        if any(int(p.rsplit("/", 1)[1].split("-")[0]) >= batch_id for p in parts):
            return
        corpus = spark.read.parquet(*parts) if parts else None
        fresh = shared.stored(dedup.unseen(batch, batch.limit(0) if corpus is None else corpus, self.keys, self.order), "batch")
        if fresh.isEmpty():
            return
        state = topic_model.load(spark, self._model_path(parts[-1])) if parts else None
        if state is None:
            whole = fresh if corpus is None else corpus.drop("topic").unionByName(fresh)
            self._write(whole, topic_model.cold_start(whole, self.vector, self.text, stop=self.stop), batch_id)
            return
        updated, labelled = topic_model.partial_update(state, fresh, self.vector, self.text, self.order)
        if topic_model.drift(updated)[2]:
            whole = corpus.drop("topic").unionByName(fresh)
            refit = topic_model.aligned(topic_model.cold_start(whole, self.vector, self.text, stop=self.stop), updated)
            self._write(whole, replace(refit, version=updated.version), batch_id)
            return
        name = f"{batch_id:010d}-part"
        topic_model.save(updated, f"{self.path}/model/{name}")
        labelled.write.mode("overwrite").parquet(f"{self.path}/corpus/{name}")

    def _write(self, whole: DataFrame, state: TopicModel, batch_id: int) -> None:
        """All rows anew. The state goes first: a part without its success mark is written again with its batch."""
        name = f"{batch_id:010d}-full"
        topic_model.save(state, f"{self.path}/model/{name}")
        topic_model.assign(state, whole, self.vector).write.mode("overwrite").parquet(f"{self.path}/corpus/{name}")

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """Fold all that is there of a stream, batch by batch, and stop."""
        query = stream.writeStream.foreachBatch(self.fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
