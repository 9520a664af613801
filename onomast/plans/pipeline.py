"""The stages from names to report."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LinkConfig
from ..cut import cut
from ..operators import labels as lab
from ..operators import match, names, nlp, report, weights
from ..sources import readers, sinks


log = logging.getLogger(__name__)


@dataclass
class Pipeline:
    """Stages A to H. Each is a lazy table built once; ``checkpoint_dir`` writes each one in turn.

    Without it the labelled and the linked tables, which are read more than once, are written to the
    shared folder of the session.
    """

    spark: SparkSession
    config: LinkConfig = LinkConfig()
    labeler: lab.Labeler = field(default_factory=lab.rule_labeler)
    tagger: nlp.Tagger = nlp.rule_tagger
    vector: object = None
    checkpoint_dir: str | None = None
    timer: sinks.Timer = field(default_factory=sinks.Timer)
    rows: dict[str, int] = field(default_factory=dict)  # of the stages that were written
    stages: dict[str, DataFrame] = field(default_factory=dict)

    def _keep(self, name: str, df: DataFrame, reused: bool = False) -> DataFrame:
        if self.checkpoint_dir is not None or reused:
            seen, counted = sinks.observed(df, name)
            write = (lambda: cut(seen)) if self.checkpoint_dir is None else (lambda: sinks.checkpointed(seen, f"{self.checkpoint_dir}/{name}"))
            df = self.timer.run(name, write)
            self.rows[name] = counted.get["rows"]
            log.info("%s: %d rows, %.1f s", name, self.rows[name], self.timer.seconds[name])
        self.stages[name] = df
        return df

    def weigh(self, table, corpus=None) -> DataFrame:
        """Splitting, cleaning, folds and weights; rows without weights go."""
        rows = readers.with_row_id(readers.as_table(self.spark, table))
        c = self.config
        rows = rows.filter(F.col(c.source).isin(c.inference, c.reference))
        # parts of one row are rows of their own from here on
        cut = names.clean_names(names.part_ids(names.split_names(rows, c)), c)
        if corpus is not None:
            corpus = names.clean_names(readers.with_row_id(readers.as_table(self.spark, corpus)), c)
        return self._keep("weighted", weights.with_weights(weights.weigh(names.folds(cut, c), corpus, c)))

    def features(self, weighted: DataFrame) -> DataFrame:
        """Raw tokens, parts of speech and vectors, reference rows first."""
        return self._keep("featured", nlp.nlp_features(names.reference_first(weighted, self.config), self.tagger, self.vector, self.config.name))

    def classify(self, featured: DataFrame) -> DataFrame:
        """Token labels."""
        return self._keep("labelled", lab.label_rows(featured, self.labeler), reused=True)

    def link(self, labelled: DataFrame) -> DataFrame:
        """The best reference of each inference row, and its alias among them."""
        c = self.config
        mine = labelled.filter(F.col(c.source) == c.inference)
        found = match.match(mine, labelled.filter(F.col(c.source) == c.reference), c)
        return self._keep("linked", match.alias(found, c), reused=True)

    def report(self, linked: DataFrame, active) -> DataFrame:
        return report.report(linked, readers.as_table(self.spark, active), self.config)

    def run(self, table, corpus=None, active=None) -> DataFrame:
        """The report over a table of row_id, name and source."""
        active = self.spark.createDataFrame([], "name string") if active is None else active
        return self.report(self.link(self.classify(self.features(self.weigh(table, corpus)))), active)
