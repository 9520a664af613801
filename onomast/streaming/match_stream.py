"""Names that arrive as a stream, matched batch by batch against a fixed pool."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..config import LinkConfig
from ..cut import scratch
from ..operators import labels as lab
from ..operators import match, nlp


def match_stream(
    arriving: DataFrame, reference: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str,
    labeler: lab.Labeler | None = None, config: LinkConfig = LinkConfig(), **trigger,
) -> StreamingQuery:
    """Starts a query that labels and matches each micro-batch of (row_id, name, source) and gives it to ``sink``.

    ``reference`` is a labelled pool. A batch that is run again after a failure has the same
    number, by which the sink can tell it. The sink has to evaluate its table: what it was made from
    is deleted when the sink returns, so a stream that runs on leaves nothing behind.
    """
    rules = labeler or lab.rule_labeler()

    def batch(df: DataFrame, number: int) -> None:
        with scratch(df.sparkSession):
            sink(match.match(lab.label_rows(nlp.nlp_features(df, vector=None, name=config.name), rules), reference, config), number)

    writer = arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
