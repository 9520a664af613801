"""Named queries over the test tables, one per operator, and the same in DuckDB SQL.

Names are made of ``part`` (and ``supplier``, ``customer`` where equal-looking words are wanted):
the tables hold no organization names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import LinkConfig, load_config
from ..functions import arrays, similarity, text
from ..operators import evaluate, labels, match, names, nlp, pairs, report, weights, wordscores
from ..sources import readers, sinks
from ..streaming.match_stream import match_stream
from ..cut import shared_dir, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_SLASH = (
    r"list_filter(list_transform(string_split(regexp_replace({}, '\b(c\s*/\s*o|contractor\s*/\s*operator)\b', '', 'gi'), '/'), "
    r"lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '')"
)
_FULL = "p_name || ' ' || p_type || ' ' || p_brand"
CTES = {
    "names": f"SELECT p_partkey AS row_id, {_FULL} AS name, CASE p_partkey % 3 WHEN 0 THEN 'inference' WHEN 1 THEN 'reference' ELSE 'database' END AS source FROM part",
    "variants": f"""SELECT p_partkey AS row_id, CASE WHEN p_partkey % 4 = 0 THEN 'inference' ELSE 'reference' END AS source, CASE p_partkey % 9
        WHEN 0 THEN {_FULL} WHEN 1 THEN {_FULL} || ' (' || p_brand || ')' WHEN 2 THEN p_name || ' / ' || p_type WHEN 3 THEN p_name || ' c/o ' || p_type
        WHEN 4 THEN p_name || ' (APAC)' WHEN 5 THEN p_name || ' (' || p_type || '/' || p_brand || ')' WHEN 6 THEN NULL
        WHEN 7 THEN '  ' || p_name || ' & Co.  ' ELSE p_name || ' - ' || p_type || ' (123-456789)' END AS name FROM part""",
    "parts": f"""SELECT row_id, source, name AS original_name, CASE WHEN source <> 'reference' THEN [name] WHEN name IS NULL THEN [] ELSE
        list_transform(list_filter(CASE WHEN t LIKE '%)' AND instr(t, '(') > 0 THEN
            CASE WHEN instr(br, '/') > 0 THEN list_concat([base], {_SLASH.format('br')})
                 WHEN instr(br, 'APAC') > 0 OR instr(br, 'EMEA') > 0 OR regexp_matches(br, '^\\d{{3}}-\\d{{6}}$') THEN [t] ELSE [base, br] END
            WHEN instr(t, '/') > 0 THEN {_SLASH.format('t')} ELSE [t] END, lambda p: p <> ''), lambda p: {STRIP.format('p')}) END AS parts
        FROM (SELECT *, {STRIP.format("split_part(t, '(', 1)")} AS base, substr(t, instr(t, '(') + 1, length(t) - instr(t, '(') - 1) AS br
              FROM (SELECT *, {STRIP.format('name')} AS t FROM variants))""",
    "split": """SELECT row_id, source, original_name, len(parts) > 1 AS is_separated, part, CASE WHEN len(parts) = 0 THEN NULL ELSE parts[part + 1] END AS name
        FROM (SELECT *, unnest(range(greatest(len(parts), 1))) AS part FROM parts)""",
    "worded": """SELECT row_id, source, name, list_filter(list_transform(list_transform(string_split(upper(coalesce(name, '')), ' '), lambda w: CASE WHEN w = '&' THEN 'AND' ELSE w END),
        lambda w: regexp_replace(w, '[^A-Za-z0-9&]', '', 'g')), lambda w: w <> '') AS words FROM names""",
    "folded": "SELECT *, (row_number() OVER (ORDER BY md5('42:' || row_id), row_id) - 1) // 200 AS fold FROM worded WHERE source <> 'database'",
    "corpus": "SELECT * FROM worded WHERE source = 'database'",
    "tf": """SELECT row_id, fold, word, min(pos) AS pos, count(*) / any_value(n) AS tf FROM (SELECT row_id, fold, len(words) AS n, unnest(words) AS word, unnest(range(len(words))) AS pos FROM folded)
        GROUP BY row_id, fold, word""",
    "idf": """SELECT fold, word, df, pow(n / (1 + df), CAST(0.67 AS DOUBLE)) - 1 AS idf FROM (
        SELECT f.fold, f.word, f.df + coalesce(c.df, 0) AS df, z.n + (SELECT count(*) FROM corpus) AS n
        FROM (SELECT fold, word, count(*) AS df FROM tf GROUP BY fold, word) f
        LEFT JOIN (SELECT word, count(*) AS df FROM (SELECT DISTINCT row_id, unnest(words) AS word FROM corpus) GROUP BY word) c ON f.word = c.word
        JOIN (SELECT fold, count(*) AS n FROM folded GROUP BY fold) z ON f.fold = z.fold)""",
    "weights": """SELECT *, tfidf / nullif(sum(tfidf) OVER (PARTITION BY row_id), 0) AS normalized FROM (
        SELECT tf.*, idf.df, idf.idf, tf.tf * idf.idf AS tfidf FROM tf JOIN idf ON tf.fold = idf.fold AND tf.word = idf.word)""",
    # names for matching: some lack the brand or the type, some repeat a word
    "short": """SELECT p_partkey AS row_id, CASE p_partkey % 7 WHEN 1 THEN p_name || ' ' || p_type WHEN 2 THEN p_name || ' ' || p_brand WHEN 3 THEN p_name ELSE p_name || ' ' || p_type || ' ' || p_brand END AS name,
        CASE p_partkey % 3 WHEN 0 THEN 'inference' WHEN 1 THEN 'reference' ELSE 'database' END AS source FROM part""",
    "tokens": """SELECT row_id, name, source, i, regexp_replace(upper(w), '[^A-Za-z0-9&]', '', 'g') AS word, CASE WHEN i <= 2 THEN 0 WHEN i = 3 THEN 1 ELSE 2 END AS label
        FROM (SELECT row_id, name, source, unnest(string_split(name, ' ')) AS w, unnest(range(1, len(string_split(name, ' ')) + 1)) AS i FROM short)""",
    "labelled": "SELECT row_id, name, source, word, min(i) AS i, arg_max(label, i) AS label FROM tokens GROUP BY row_id, name, source, word",
    "lists": """SELECT row_id, name, source, coalesce(list(word ORDER BY i) FILTER (WHERE label = 0), []) AS imp, coalesce(list(word ORDER BY i) FILTER (WHERE label = 1), []) AS sub,
        coalesce(list(word ORDER BY i) FILTER (WHERE label = 2), []) AS gen FROM labelled GROUP BY row_id, name, source""",
    "vocab": "SELECT DISTINCT word FROM labelled WHERE label = 0 UNION SELECT ''",
    "steps": """SELECT x.word AS a, y.word AS b, 0 AS j, (CAST(1 AS BIGINT) << length(x.word)) - 1 AS s FROM vocab x, vocab y
        UNION ALL SELECT a, b, j + 1, ((s + (s & m)) | (s - (s & m))) & ((CAST(1 AS BIGINT) << length(a)) - 1) FROM (
            SELECT *, CAST(coalesce(list_sum(list_transform(range(length(a)), lambda k: CASE WHEN substr(a, CAST(k + 1 AS BIGINT), 1) = substr(b, j + 1, 1) THEN CAST(1 AS BIGINT) << k ELSE 0 END)), 0) AS BIGINT) AS m
            FROM steps WHERE j < length(b))""",
    "ratios": """SELECT a, b, CAST(CASE WHEN a = b THEN 100 WHEN length(a) + length(b) = 0 THEN 100 ELSE round_even(200.0 * (length(a) - bit_count(s)) / (length(a) + length(b)), 0) END AS INTEGER) AS r
        FROM steps WHERE j = length(b)""",
    "pairs": """SELECT i.row_id, i.name, r.row_id AS ref_id, r.name AS ref_name, greatest(len(i.imp), len(r.imp)) AS n, i.sub AS s1, r.sub AS s2, i.gen AS g1, r.gen AS g2,
        (SELECT r FROM ratios WHERE a = coalesce(r.imp[1], '') AND b = coalesce(i.imp[1], '')) AS r1, (SELECT r FROM ratios WHERE a = coalesce(r.imp[2], '') AND b = coalesce(i.imp[2], '')) AS r2
        FROM (SELECT * FROM lists WHERE source = 'inference') i, (SELECT * FROM lists WHERE source = 'reference') r""",
    "scored": """SELECT *, CASE WHEN s0 < 85 - 1e-9 THEN s0 ELSE s0 + sub + gen END AS score,
        CASE WHEN s0 < 85 - 1e-9 THEN NULL WHEN sub < 9.5 THEN 'Subsidiary' WHEN gen < 4.75 THEN 'Alias' WHEN s0 + sub + gen >= 100 - 1e-9 THEN 'Match' END AS category FROM (
        SELECT *, CASE n WHEN 0 THEN 0 WHEN 1 THEN 85 * r1 / 100.0 ELSE 85 * (r1 * 0.8 + r2 * 0.2) / 100.0 END AS s0, CASE WHEN s1 = s2 THEN 10.0 ELSE 0.0 END AS sub, CASE WHEN g1 = g2 THEN 5.0 ELSE 0.0 END AS gen FROM pairs)""",
    "best": """SELECT row_id, name, ref_id, ref_name, score, category FROM (
        SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY round(score, 9) DESC, ref_id) AS k FROM scored) WHERE k = 1""",
    "selfpairs": """SELECT x.row_id, y.row_id AS other_id, y.name AS other FROM lists x, lists y WHERE x.source = 'inference' AND y.source = 'inference' AND len(x.imp) > 0 AND x.imp = y.imp AND x.sub = y.sub""",
    "aliased": """SELECT row_id, coalesce((SELECT arg_max(other, length(other) * 1000000 - other_id) FROM selfpairs s WHERE s.row_id = l.row_id), '') AS alias FROM lists l WHERE source = 'inference'""",
    "active": "SELECT name FROM (SELECT name, unnest(range(1 + row_id % 3)) FROM short WHERE source = 'reference' AND row_id % 2 = 1)",
    "linked": "SELECT b.row_id, b.name, 'inference' AS source, b.ref_name AS matched_name, b.score, b.category, a.alias FROM best b JOIN aliased a ON a.row_id = b.row_id",
    "flow": """SELECT name AS "Inference Company Name", source AS "Source", CASE WHEN branch = 1 THEN '' ELSE matched_name END AS "Reference Company Name", round(score, 6) AS "Match Score",
        category AS "Match Category", alias AS "Standardized Alias", n AS "Count" FROM (
        SELECT *, count(*) OVER (PARTITION BY upper(name)) AS n, row_number() OVER (PARTITION BY upper(name) ORDER BY branch, row_id) AS k
        FROM (SELECT *, CASE WHEN score >= 50 THEN 0 ELSE 1 END AS branch FROM linked)) WHERE k = 1""",
}


def sql(body: str, *wanted: str) -> str:
    """``body`` with the common tables it asks for, and those that they ask for, before it."""
    found: list[str] = []

    def add(c):
        for d in CTES:
            if d != c and any(x in CTES[c].split() or x in CTES[c].replace("(", " ").replace(")", " ").replace(",", " ").split() for x in [d]):
                add(d)
        if c not in found:
            found.append(c)

    for c in wanted:
        add(c)
    if not found:
        return body
    return "WITH RECURSIVE " + ", ".join(f"{c} AS ({CTES[c]})" for c in found) + " " + body


def query(name: str, oracle: str | None = None, *ctes: str):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLE_SQL[name] = sql(oracle, *ctes)
        return f

    return add


def _part(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet")


def _source(key: Column) -> Column:
    return F.when(key % 3 == 0, "inference").when(key % 3 == 1, "reference").otherwise("database")


def _names(spark, d):
    return _part(spark, d).select(F.col("p_partkey").alias("row_id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("name"), _source(F.col("p_partkey")).alias("source"))


def _variants(spark, d):
    k = F.col("p_partkey") % 9
    full = F.concat_ws(" ", "p_name", "p_type", "p_brand")
    name = (
        F.when(k == 0, full).when(k == 1, F.format_string("%s (%s)", full, "p_brand")).when(k == 2, F.concat_ws(" / ", "p_name", "p_type"))
        .when(k == 3, F.concat_ws(" c/o ", "p_name", "p_type")).when(k == 4, F.concat("p_name", F.lit(" (APAC)"))).when(k == 5, F.format_string("%s (%s/%s)", "p_name", "p_type", "p_brand"))
        .when(k == 6, F.lit(None)).when(k == 7, F.format_string("  %s & Co.  ", "p_name")).otherwise(F.format_string("%s - %s (123-456789)", "p_name", "p_type"))
    )
    return _part(spark, d).select(F.col("p_partkey").alias("row_id"), F.when(F.col("p_partkey") % 4 == 0, "inference").otherwise("reference").alias("source"), name.alias("name"))


def _worded(spark, d):
    return names.clean_names(_names(spark, d)).select("row_id", "source", "name", "words")


def _folded(spark, d):
    return names.folds(_worded(spark, d).filter("source <> 'database'"))


def _corpus(spark, d):
    return _worded(spark, d).filter("source = 'database'")


def _weights(spark, d):
    return weights.weights_long(_folded(spark, d).select("row_id", "fold", "words"), _corpus(spark, d))


def _short(spark, d):
    k = F.col("p_partkey") % 7
    name = F.when(k == 1, F.concat_ws(" ", "p_name", "p_type")).when(k == 2, F.concat_ws(" ", "p_name", "p_brand")).when(k == 3, F.col("p_name")).otherwise(F.concat_ws(" ", "p_name", "p_type", "p_brand"))
    return _part(spark, d).select(F.col("p_partkey").alias("row_id"), name.alias("name"), _source(F.col("p_partkey")).alias("source"))


def _raw(spark, d):
    """Names with their raw words, over all cores: what is made of the words costs far more than reading them."""
    return spread(_short(spark, d), "row_id").withColumn("words", text.raw_words(F.col("name")))


def _labelled(spark, d):
    return labels.label_rows(_raw(spark, d), labels.position_labeler())


def _sides(spark, d):
    rows = _labelled(spark, d).select("row_id", "name", "source", "labels")
    return rows.filter("source = 'inference'"), rows.filter("source = 'reference'")


def _active(spark, d):
    return _short(spark, d).filter("source = 'reference' and row_id % 2 = 1").select("name", F.explode(F.sequence(F.lit(0), (F.col("row_id") % 3).cast("int")))).select("name")


def _linked(spark, d):
    mine, pool = _sides(spark, d)
    return match.alias(match.match(mine, pool)).drop("labels")


def _joined(c: str, by: str = "|") -> Column:
    return F.array_join(c, by).alias(c)


def r6(c: str) -> Column:
    return F.round(c, 6).alias(c)


def _place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, so that runs at one time don't meet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _small(spark, d):
    """A table of names with what formats have to carry: nulls, numbers, quotes, line breaks, non-ASCII letters."""
    k = F.col("p_partkey") % 5
    name = F.when(k == 0, F.lit(None)).when(k == 1, F.concat(F.col("p_name"), F.lit(' "x", <é>'))).when(k == 2, F.concat(F.col("p_name"), F.lit("\n&"))).otherwise(F.col("p_name"))
    return _part(spark, d).select("p_partkey", name.alias("name"), (F.col("p_size") / 4.0).alias("x"))


_SMALL = """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN p_name || ' "x", <é>' WHEN 2 THEN p_name || chr(10) || '&' ELSE p_name END AS name, p_size / 4.0 AS x FROM part"""


# --- sources and sinks: each writes all rows and reads them back


@query("src1_excel_sheet", _SMALL)
def _(spark, d):
    path = _place(spark, "names") + ".xlsx"
    sinks.save_results(_small(spark, d), path, "excel")
    return readers.read_table(spark, path)


@query("src3_corpus_of_json_records", f"SELECT p_partkey, name FROM ({_SMALL})")
def _(spark, d):
    """A JSON array of objects, over several lines."""
    path = _place(spark, "records")
    records = _small(spark, d).select(F.to_json(F.struct("p_partkey", "name")).alias("r")).groupBy(F.col("r").isNull().alias("g")).agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list("r"), ",\n"), F.lit("\n]")).alias("value"))
    records.select("value").write.text(path)
    return readers.read_table(spark, path, "json_records", schema="p_partkey long, name string")


@query("src4_input_of_json_lines", _SMALL)
def _(spark, d):
    path = _place(spark, "lines")
    sinks.save_results(_small(spark, d), path, "json")
    return readers.read_table(spark, path, "json", schema="p_partkey long, name string, x double")


@query("src5_training_rows_of_json", "SELECT row_id, array_to_string(words, '|') AS words FROM worded", "worded")
def _(spark, d):
    path = _place(spark, "training")
    sinks.save_results(_worded(spark, d).select("row_id", "words"), path, "json")
    return readers.read_table(spark, path, "json", schema="row_id long, words array<string>").withColumn("words", _joined("words"))


@query("src8_settings", "SELECT p_partkey, p_partkey // 50 AS fold, CAST(0.5 AS DOUBLE) AS power FROM part")
def _(spark, d):
    """Settings of an INI file in use."""
    import tempfile

    with tempfile.NamedTemporaryFile("w", suffix=".ini") as f:  # read on the driver at once
        f.write("[weights]\nfold_size = 50\nidf_power = '0.5'\nother = 1\n")
        f.flush()
        c = load_config(f.name)
    return _part(spark, d).select("p_partkey", F.floor(F.col("p_partkey") / c.fold_size).alias("fold"), F.lit(c.idf_power).alias("power"))


@query("src9_saved_labeler", "SELECT DISTINCT row_id FROM tokens WHERE row_id % 5 = 0", "tokens")
def _(spark, d):
    """A labeler that was saved and loaded gives each row the labels of the one that was trained: the rows where it does."""
    rows = labels.position_labeler()(_raw(spark, d))
    path = _place(spark, "labeler")
    trained = labels.train_labeler(rows.filter("row_id % 5 <> 0"), 128)
    labels.save_labeler(trained, path)
    held = rows.filter("row_id % 5 = 0").select("row_id", "words")
    one, two = (labels.model_labeler(m)(held).select("row_id", F.col("label_list").alias(c)) for m, c in ((trained, "a"), (labels.load_labeler(path), "b")))
    return one.join(two, "row_id").filter("a = b").select("row_id")


@query("snk1_stage_checkpoint", "SELECT row_id, array_to_string(words, '|') AS words FROM worded", "worded")
def _(spark, d):
    return sinks.checkpointed(_worded(spark, d).select("row_id", "words"), _place(spark, "stage")).withColumn("words", _joined("words"))


@query("snk4_csv_of_nested_rows", "SELECT row_id, array_to_string(words, '|') AS words FROM worded", "worded")
def _(spark, d):
    path = _place(spark, "csv")
    sinks.save_results(_worded(spark, d).select("row_id", "words"), path, "csv", single=True)
    return readers.parse_nested(readers.read_table(spark, path, "csv", schema="row_id long, words string")).withColumn("words", _joined("words"))


@query("snk5_saved_idf", "SELECT row_id, word, round(tfidf, 6) AS tfidf FROM weights", "weights")
def _(spark, d):
    """Weights by an IDF table that an earlier run saved."""
    path, rows = _place(spark, "idf"), _folded(spark, d).select("row_id", "fold", "words")
    sinks.save_idf(weights.idf_table(rows, _corpus(spark, d)), path)
    return weights.weights_long(rows, idf=sinks.load_idf(spark, path)).select("row_id", "word", r6("tfidf"))


@query("snk7_saved_results", "SELECT row_id, name FROM names", "names")
def _(spark, d):
    path = _place(spark, "results")
    sinks.save_results(_names(spark, d), path, "orc")
    return readers.read_table(spark, path, "orc").select("row_id", "name")


@query("snk8_stage_counts", "SELECT 'names' AS stage, count(*) AS n FROM names UNION ALL SELECT 'split', count(*) FROM split", "names", "split")
def _(spark, d):
    """Rows of stages, counted as they are written."""
    found = []
    for stage, df in (("names", _names(spark, d)), ("split", names.split_names(_variants(spark, d)))):
        seen, counted = sinks.observed(df, stage)
        seen.write.format("noop").mode("overwrite").save()
        found.append((stage, counted.get["rows"]))
    return spark.createDataFrame(found, "stage string, n long")


@query("agg11_timed_stages", "SELECT 2 AS stages, true AS summed")
def _(spark, d):
    timer = sinks.Timer()
    for stage in ("a", "b"):
        timer.run(stage, lambda: _part(spark, d).count())
    return spark.createDataFrame([(len(timer.seconds), abs(timer.total - sum(timer.seconds.values())) < 1e-9 and timer.total > 0)], "stages int, summed boolean")


@query("cli1_stage_from_file_to_file", "SELECT row_id, array_to_string(words, '|') AS words FROM worded WHERE source = 'reference'", "worded")
def _(spark, d):
    """The corpus stage of the command line."""
    from . import cli

    rows, out = _place(spark, "in") + ".jsonl", _place(spark, "out")
    _names(spark, d).write.json(rows)
    cli.main(["corpus", "--input", rows, "--output", out, "--format", "parquet"], spark)
    return spark.read.parquet(out).select("row_id", _joined("words"))


@query("cli3_trained_and_applied", "SELECT row_id, least(10, len(string_split(name, ' '))) AS n FROM short", "short")
def _(spark, d):
    """The classifier's command in mode train, then in mode test with the model's name."""
    from . import cli

    rows, model, out = _place(spark, "in") + ".parquet", _place(spark, "model"), _place(spark, "out")
    labels.position_labeler()(_raw(spark, d)).write.parquet(rows)
    cli.main(["classify", "--i", rows, "--o", out, "--m", "train", "--mn", model], spark)
    cli.main(["classify", "--i", rows, "--o", out, "--m", "test", "--mn", model, "--format", "parquet"], spark)
    return spark.read.parquet(out).select("row_id", F.size("label_list").cast("long").alias("n"))


@query("cli4_features", "SELECT row_id, len(string_split(name, ' ')) AS n FROM short", "short")
def _(spark, d):
    from . import cli

    rows, out = _place(spark, "in") + ".parquet", _place(spark, "out")
    _short(spark, d).write.parquet(rows)
    cli.main(["features", "--i", rows, "--o", out, "--format", "parquet"], spark)
    return spark.read.parquet(out).select("row_id", F.size("words").cast("long").alias("n"))


# --- projections


@query("src2_table_in_memory", "SELECT p_partkey, p_name FROM part WHERE p_partkey < 100")
def _(spark, d):
    frame = _part(spark, d).filter("p_partkey < 100").select("p_partkey", "p_name").toPandas()
    return readers.as_table(spark, frame)


@query("src6_active_names", "SELECT name, count(*) AS n FROM active GROUP BY name", "active")
def _(spark, d):
    return readers.as_table(spark, _active(spark, d)).groupBy("name").agg(F.count("*").alias("n"))


@query("prj1_copy_of_name", "SELECT row_id, CAST(part AS INTEGER) AS part, original_name FROM split", "split")
def _(spark, d):
    return names.split_names(_variants(spark, d)).select("row_id", "part", "original_name")


@query("prj2_rename_if_present", "SELECT p_partkey AS row_id, p_name AS name FROM part")
def _(spark, d):
    return readers.names_table(_part(spark, d).select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("CompanyName")))


@query("prj3_drop_helpers", "SELECT p_partkey, p_name FROM part")
def _(spark, d):
    return _part(spark, d).drop("p_brand", "p_type", "p_size", "p_retailprice", "not_there")


@query("prj4_present_columns", "SELECT row_id, name, source FROM names", "names")
def _(spark, d):
    return report.present(_names(spark, d).withColumn("other", F.lit(1)), report.DETAIL)


@query("prj6_second_pass_columns", "SELECT row_id, name, source, array_to_string(words, '|') AS words FROM worded", "worded")
def _(spark, d):
    return report.present(_worded(spark, d).withColumn("score", F.lit(1.0)), report.SECOND_PASS).withColumn("words", _joined("words"))


@query("prj7_fields_of_match", "SELECT row_id, ref_name, CASE WHEN category IS NULL THEN '' ELSE category END AS category FROM best", "best")
def _(spark, d):
    m = match.match(*_sides(spark, d)).withColumn("m", F.struct("matched_name", "category"))
    return m.select("row_id", F.col("m.matched_name").alias("ref_name"), F.coalesce("m.category", F.lit("")).alias("category"))


@query("prj8_constant_columns", "SELECT row_id, '' AS matched_name, 0 AS n FROM names", "names")
def _(spark, d):
    return _names(spark, d).select("row_id", F.lit("").alias("matched_name"), F.size(F.array().cast("array<string>")).alias("n"))


@query("prj9_missing_list_to_empty", "SELECT b.row_id, CAST(coalesce(h.n, 0) AS INTEGER) AS n FROM best b LEFT JOIN (SELECT name, count(*) AS n FROM active GROUP BY name) h ON h.name = b.ref_name", "best", "active")
def _(spark, d):
    return report.with_history(match.match(*_sides(spark, d)), _active(spark, d)).select("row_id", F.size("history").alias("n"))


# --- filters


@query("flt1_source_in", "SELECT row_id FROM names WHERE source IN ('inference', 'reference')", "names")
def _(spark, d):
    return _names(spark, d).filter(F.col("source").isin("inference", "reference")).select("row_id")


@query("flt2_source_is", "SELECT row_id FROM names WHERE source = 'database'", "names")
def _(spark, d):
    return _names(spark, d).filter("source = 'database'").select("row_id")


@query("flt3_with_weights", "SELECT DISTINCT row_id FROM weights", "weights")
def _(spark, d):
    return weights.with_weights(weights.weigh(_folded(spark, d).withColumn("words", F.when(F.col("row_id") >= 0, F.col("words"))), _corpus(spark, d))).select("row_id")


@query("flt4_owner_role", "SELECT p_partkey AS row_id FROM part WHERE p_partkey % 3 = 1 AND p_size % 2 = 1")
def _(spark, d):
    rows = _part(spark, d).select(F.col("p_partkey").alias("row_id"), (F.col("p_size") % 2).alias("has_owner_role"), _source(F.col("p_partkey")).alias("source"))
    return names.active_owners(rows).select("row_id")


@query("flt5_split_at_50", "SELECT row_id, CASE WHEN score >= 50 THEN 'high' ELSE 'low' END AS side FROM best", "best")
def _(spark, d):
    high, low = report.split_by_score(match.match(*_sides(spark, d)))
    return high.select("row_id", F.lit("high").alias("side")).union(low.select("row_id", F.lit("low")))


@query("flt6_split_at_85", "SELECT row_id, score >= 85 - 1e-9 AS high FROM best", "best")
def _(spark, d):
    high, low = report.split_by_score(match.match(*_sides(spark, d)), 85.0 - 1e-9)
    return high.select("row_id", F.lit(True).alias("high")).union(low.select("row_id", F.lit(False)))


@query("flt7_match_or_alias", "SELECT row_id FROM best WHERE category IN ('Match', 'Alias')", "best")
def _(spark, d):
    return match.match(*_sides(spark, d)).filter(F.col("category").isin("Match", "Alias")).select("row_id")


@query("flt8_has_tokens", "SELECT row_id FROM worded WHERE len(words) > 3", "worded")
def _(spark, d):
    return _worded(spark, d).filter(F.size("words") > 3).select("row_id")


@query("flt9_pool_by_table", "SELECT p_partkey AS row_id, p_type <> 'PROMO' AS first_pool FROM part")
def _(spark, d):
    rows = _part(spark, d).select(F.col("p_partkey").alias("row_id"), F.col("p_type").alias("database_table"))
    return rows.filter("database_table <> 'PROMO'").select("row_id", F.lit(True).alias("first_pool")).union(rows.filter("database_table = 'PROMO'").select("row_id", F.lit(False)))


@query("flt10_reference_for_corpus", "SELECT row_id, name FROM names WHERE source = 'reference'", "names")
def _(spark, d):
    return _names(spark, d).filter("source = 'reference'").select("row_id", "name")


@query("flt11_drop_none_labels", "SELECT row_id, array_to_string(list_filter([row_id % 4, 3, row_id % 2], lambda x: x <> 3), ',') AS kept FROM names", "names")
def _(spark, d):
    lst = F.array(*[F.col("row_id") % 4, F.lit(3).cast("long"), F.col("row_id") % 2])
    return _names(spark, d).select("row_id", F.array_join(F.transform(arrays.drop_none_labels(lst), lambda x: x.cast("string")), ",").alias("kept"))


@query("flt12_drop_empty_words", "SELECT row_id, array_to_string(list_filter(string_split(name, ' '), lambda w: w <> ''), '|') AS words FROM variants", "variants")
def _(spark, d):
    return _variants(spark, d).select("row_id", F.array_join(text.drop_empty(text.split_blank(F.col("name"))), "|").alias("words"))


# --- joins


@query("join1_best_reference", "SELECT row_id, ref_id, round(score, 6) AS score, category FROM best", "best")
def _(spark, d):
    return match.match(*_sides(spark, d)).select("row_id", F.col("matched_id").alias("ref_id"), r6("score"), "category")


@query("join2_self_match_alias", "SELECT row_id, alias FROM aliased", "aliased")
def _(spark, d):
    return match.alias(_sides(spark, d)[0]).select("row_id", "alias")


@query("join3_active_history", "SELECT b.row_id, b.ref_name, h.n FROM best b LEFT JOIN (SELECT name, count(*) AS n FROM active GROUP BY name) h ON h.name = b.ref_name WHERE h.n IS NOT NULL", "best", "active")
def _(spark, d):
    m = report.with_history(match.match(*_sides(spark, d)), _active(spark, d))
    return m.filter("size(history) > 0").select("row_id", F.col("matched_name").alias("ref_name"), F.size("history").cast("long").alias("n"))


@query("join4_counts_on_name", "SELECT row_id, count(*) OVER (PARTITION BY upper(name)) AS n FROM names WHERE name IS NOT NULL", "names")
def _(spark, d):
    return _names(spark, d).filter("name is not null").select("row_id", F.count("*").over(Window.partitionBy(text.name_key(F.col("name")))).alias("n"))


@query("join5_weights_by_word", "SELECT row_id, word, round(tf, 6) AS tf, round(idf, 6) AS idf, round(tfidf, 6) AS tfidf FROM weights", "weights")
def _(spark, d):
    return _weights(spark, d).select("row_id", "word", r6("tf"), r6("idf"), r6("tfidf"))


_CASCADE = """SELECT row_id, ref_id, round(score, 6) AS score, category, pool FROM (
    SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY pool) AS k FROM (
        SELECT row_id, ref_id, score, category, 0 AS pool FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY round(score, 9) DESC, ref_id) AS k FROM scored WHERE ref_id % 2 = 1) WHERE k = 1 AND score >= 85 - 1e-9
        UNION ALL SELECT row_id, ref_id, score, category, 1 FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY round(score, 9) DESC, ref_id) AS k FROM scored WHERE ref_id % 2 = 0) WHERE k = 1)) WHERE k = 1"""


@query("join6_cascade", _CASCADE, "scored")
def _(spark, d):
    mine, pool = _sides(spark, d)
    found = match.cascade(mine, [pool.filter("row_id % 2 = 1"), pool.filter("row_id % 2 = 0")])
    return found.select("row_id", F.col("matched_id").alias("ref_id"), r6("score"), "category", "pool")


def _vocab(spark, d):
    imp = _labelled(spark, d).select(F.explode(arrays.words_with_label(F.col("labels"), 0)).alias("word")).distinct()
    return imp.union(spark.createDataFrame([("",)], "word string"))


@query("join7_word_pairs", "SELECT a, b FROM ratios WHERE r >= 50", "ratios")
def _(spark, d):
    v = _vocab(spark, d)
    pairs = v.select(F.col("word").alias("a")).crossJoin(v.select(F.col("word").alias("b")))
    return pairs.filter(similarity.most_ratio(F.length("a"), F.length("b")) >= 50).filter(similarity.ratio("a", "b") >= 50)


# --- aggregates


@query("agg1_term_frequency", "SELECT row_id, word, CAST(pos AS INTEGER) AS pos, round(tf, 6) AS tf FROM tf", "tf")
def _(spark, d):
    return weights.term_frequency(_folded(spark, d), ("fold",)).select("row_id", "word", "pos", r6("tf"))


@query("agg2_document_frequency", "SELECT word, count(*) AS df FROM (SELECT DISTINCT row_id, unnest(words) AS word FROM worded) GROUP BY word", "worded")
def _(spark, d):
    return weights.document_frequency(_worded(spark, d))


@query("agg3_corpus_size", "SELECT fold, count(*) AS n FROM folded GROUP BY fold", "folded")
def _(spark, d):
    return weights.corpus_size(_folded(spark, d), ("fold",))


@query("agg4_weight_sums", "SELECT row_id, round(sum(tfidf), 6) AS total FROM weights GROUP BY row_id", "weights")
def _(spark, d):
    return _weights(spark, d).groupBy("row_id").agg(F.round(F.sum("tfidf"), 6).alias("total"))


@query("agg5_global_bounds", "SELECT round(min(tfidf), 6) AS low, round(max(tfidf), 6) AS high FROM weights", "weights")
def _(spark, d):
    return _weights(spark, d).agg(F.round(F.min("tfidf"), 6).alias("low"), F.round(F.max("tfidf"), 6).alias("high"))


@query("agg6_collected_names", "SELECT name AS matched_name, count(*) AS n FROM active GROUP BY name", "active")
def _(spark, d):
    return report.history(_active(spark, d)).select("matched_name", F.size("history").cast("long").alias("n"))


@query("agg7_name_counts", "SELECT upper(trim(name)) AS key, count(*) AS n FROM names GROUP BY 1", "names")
def _(spark, d):
    return _names(spark, d).groupBy(text.name_key(F.col("name")).alias("key")).agg(F.count("*").alias("n"))


@query("agg8_source_counts", "SELECT source, count(*) AS n FROM names GROUP BY source", "names")
def _(spark, d):
    return evaluate.source_counts(_names(spark, d))


@query("agg9_label_counts", "SELECT row_id, len(imp) AS important, len(sub) AS subsidiary, len(gen) AS generic FROM lists", "lists")
def _(spark, d):
    return _labelled(spark, d).select("row_id", *[arrays.count_label(F.col("labels"), k).cast("long").alias(c) for k, c in enumerate(["important", "subsidiary", "generic"])])


@query("agg10_token_accuracy", "SELECT round(coalesce(avg(CAST(quality = toxic AS DOUBLE)), 0), 6) AS accuracy FROM labels WHERE quality <> 3")
def _(spark, d):
    return evaluate.token_accuracy(spark.read.parquet(f"{d}/labels.parquet"), "quality", "toxic").select(r6("accuracy"))


# --- order, limits, folds


@query("top1_best_score", "SELECT row_id, ref_id FROM best", "best")
def _(spark, d):
    return match.match(*_sides(spark, d)).select("row_id", F.col("matched_id").alias("ref_id"))


@query("top2_longest_name", "SELECT source, arg_max(name, length(name) * 1000000 - row_id) AS longest FROM names GROUP BY source", "names")
def _(spark, d):
    return _names(spark, d).groupBy("source").agg(F.max_by("name", F.struct(F.length("name"), -F.col("row_id"))).alias("longest"))


@query("srt1_report_order", 'SELECT * FROM flow', "flow")
def _(spark, d):
    out = report.report(_linked(spark, d), _active(spark, d))
    return out.withColumn("Match Score", F.round("Match Score", 6))


@query("srt2_top_example", "SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 1")
def _(spark, d):
    return _part(spark, d).orderBy(F.desc("p_retailprice"), "p_partkey").limit(1).select("p_partkey")


@query("lim1_preview", "SELECT row_id, name FROM names ORDER BY row_id LIMIT 100", "names")
def _(spark, d):
    return _names(spark, d).orderBy("row_id").limit(100).select("row_id", "name")


@query("lim3_first_row", "SELECT row_id, name FROM names ORDER BY row_id LIMIT 1", "names")
def _(spark, d):
    return _names(spark, d).orderBy("row_id").limit(1).select("row_id", "name")


@query("lim2_first_of_source", "(SELECT row_id FROM names WHERE source = 'database' ORDER BY row_id LIMIT 100) UNION ALL SELECT row_id FROM names WHERE source = 'reference' AND row_id % 2 = 1", "names")
def _(spark, d):
    return names.active_owners(_names(spark, d).withColumn("has_owner_role", F.col("row_id") % 2), "database").select("row_id")


@query("rnd1_seeded_shuffle", "SELECT row_id, row_number() OVER (ORDER BY md5('42:' || row_id), row_id) AS rank FROM names", "names")
def _(spark, d):
    return names.seeded_rank(_names(spark, d), 42).select("row_id", "rank")


@query("prt1_folds", "SELECT row_id, fold FROM folded", "folded")
def _(spark, d):
    return _folded(spark, d).select("row_id", "fold")


# --- sets and reshaping


@query("set1_input_and_corpus", "SELECT row_id, source, CASE WHEN source = 'database' THEN NULL ELSE name END AS name FROM names", "names")
def _(spark, d):
    n = _names(spark, d)
    return names.with_corpus(n.filter("source <> 'database'"), n.filter("source = 'database'").drop("name"))


@query("set2_fold_with_corpus", "SELECT fold, word, df FROM idf", "idf")
def _(spark, d):
    return weights.idf_table(_folded(spark, d), _corpus(spark, d)).select("fold", "word", "df")


@query("set3_corpus_and_folds", "SELECT row_id, -1 AS fold FROM corpus UNION ALL SELECT row_id, fold FROM folded", "corpus", "folded")
def _(spark, d):
    return _corpus(spark, d).select("row_id", F.lit(-1).cast("long").alias("fold")).unionByName(_folded(spark, d).select("row_id", "fold"))


@query("set4_reference_first", "SELECT row_id, source FROM names WHERE source IN ('reference', 'inference')", "names")
def _(spark, d):
    return names.reference_first(_names(spark, d)).select("row_id", "source")


@query("set5_matched_and_unmatched", "SELECT row_id, CASE WHEN score >= 50 THEN 0 ELSE 1 END AS branch, CASE WHEN score >= 50 THEN matched_name ELSE '' END AS matched_name FROM (SELECT *, row_number() OVER (PARTITION BY upper(name) ORDER BY CASE WHEN score >= 50 THEN 0 ELSE 1 END, row_id) AS k FROM linked) WHERE k = 1", "linked")
def _(spark, d):
    return report.consolidate(_linked(spark, d), _active(spark, d)).select("row_id", "branch", "matched_name")


@query("set6_cascade_union", "SELECT pool, count(*) AS n FROM (" + _CASCADE + ") GROUP BY pool", "scored")
def _(spark, d):
    mine, pool = _sides(spark, d)
    return match.cascade(mine, [pool.filter("row_id % 2 = 1"), pool.filter("row_id % 2 = 0")]).groupBy("pool").agg(F.count("*").alias("n"))


@query("ded1_first_of_name", "SELECT row_id, n FROM (SELECT row_id, count(*) OVER (PARTITION BY upper(name)) AS n, row_number() OVER (PARTITION BY upper(name) ORDER BY row_id) AS k FROM names) WHERE k = 1", "names")
def _(spark, d):
    return report.counted_first(_names(spark, d).withColumn("branch", F.lit(0))).select("row_id", F.col("count").alias("n"))


@query("exp1_name_parts", "SELECT row_id, CAST(part AS INTEGER) AS part, name FROM split", "split")
def _(spark, d):
    return names.split_names(_variants(spark, d)).select("row_id", "part", "name")


@query("exp2_match_or_null", "SELECT l.row_id, CAST(b.ref_id AS VARCHAR) AS ref_id FROM (SELECT row_id FROM short WHERE source <> 'database') l LEFT JOIN best b ON b.row_id = l.row_id", "short", "best")
def _(spark, d):
    mine, pool = _sides(spark, d)
    rows = mine.unionByName(pool.withColumn("labels", F.slice("labels", 1, 0)))
    return match.match(rows, pool).select("row_id", F.col("matched_id").cast("string").alias("ref_id"))


# --- strings


@query("str1_upper", "SELECT row_id, upper(coalesce(name, '')) AS name FROM variants", "variants")
def _(spark, d):
    return _variants(spark, d).select("row_id", text.upper_or_empty(F.col("name")).alias("name"))


@query("str2_split_blank", "SELECT row_id, len(string_split(name, ' ')) AS n, array_to_string(string_split(name, ' '), '|') AS words FROM variants WHERE name IS NOT NULL", "variants")
def _(spark, d):
    w = text.split_blank(F.col("name"))
    return _variants(spark, d).filter("name is not null").select("row_id", F.size(w).cast("long").alias("n"), F.array_join(w, "|").alias("words"))


@query("str3_ampersand", "SELECT row_id, array_to_string(list_transform(string_split(name, ' '), lambda w: CASE WHEN w = '&' THEN 'AND' ELSE w END), '|') AS words FROM variants", "variants")
def _(spark, d):
    return _variants(spark, d).select("row_id", F.array_join(text.ampersand_word(text.split_blank(F.col("name"))), "|").alias("words"))


@query("str4_plain_words", "SELECT row_id, array_to_string(list_transform(string_split(name, ' '), lambda w: regexp_replace(w, '[^A-Za-z0-9&]', '', 'g')), '|') AS words FROM variants", "variants")
def _(spark, d):
    return _variants(spark, d).select("row_id", F.array_join(text.plain_words(text.split_blank(F.col("name"))), "|").alias("words"))


@query("str5_split_compound", "SELECT row_id, len(parts) AS n, array_to_string(parts, '|') AS parts FROM parts WHERE source = 'reference'", "parts")
def _(spark, d):
    rows = _variants(spark, d).filter("source = 'reference'").withColumn("parts", text.split_compound(F.col("name")))
    return rows.select("row_id", F.size("parts").cast("long").alias("n"), _joined("parts"))


@query("str6_split_slash", f"SELECT row_id, array_to_string({_SLASH.format('name')}, '|') AS parts FROM variants", "variants")
def _(spark, d):
    return _variants(spark, d).select("row_id", F.array_join(text.split_slash(F.col("name")), "|").alias("parts"))


@query("str7_bracket_guard", r"SELECT row_id, instr(b, 'APAC') > 0 OR instr(b, 'EMEA') > 0 OR regexp_matches(b, '^\d{3}-\d{6}$') AS keeps FROM (SELECT row_id, regexp_extract(name, '\((.*)\)$', 1) AS b FROM variants WHERE name LIKE '%)')", "variants")
def _(spark, d):
    return _variants(spark, d).filter("name like '%)'").select("row_id", text.keeps_bracket(F.regexp_extract("name", r"\((.*)\)$", 1)).alias("keeps"))


@query("str8_spaced_hyphen", "SELECT row_id, replace(name, ' - ', ' ') AS name FROM variants", "variants")
def _(spark, d):
    return _variants(spark, d).select("row_id", F.array_join(text.raw_words(F.col("name")), " ").alias("name"))


@query("str9_name_key", f"SELECT row_id, upper({STRIP.format('name')}) AS key FROM variants", "variants")
def _(spark, d):
    return _variants(spark, d).select("row_id", text.name_key(F.col("name")).alias("key"))


@query("str10_length", "SELECT row_id, length(coalesce(name, '')) AS n FROM variants", "variants")
def _(spark, d):
    return _variants(spark, d).select("row_id", F.length(F.coalesce("name", F.lit(""))).cast("long").alias("n"))


@query("str11_ratio", "SELECT a, b, r FROM ratios WHERE a <> '' AND b <> ''", "ratios")
def _(spark, d):
    v = _vocab(spark, d).filter("word <> ''")
    return v.select(F.col("word").alias("a")).crossJoin(v.select(F.col("word").alias("b"))).select("a", "b", similarity.ratio("a", "b").alias("r"))


@query("str11_ratio_expression", "SELECT a, b, r FROM ratios WHERE a <> '' AND b <> '' AND a < b", "ratios")
def _(spark, d):
    v = _vocab(spark, d).filter("word <> ''")
    pairs = v.select(F.col("word").alias("a")).crossJoin(v.select(F.col("word").alias("b"))).filter("a < b")
    return pairs.select("a", "b", similarity.ratio_expr(F.col("a"), F.col("b")).alias("r"))


@query("str12_metaphone")
def _(spark, d):
    return _worded(spark, d).select(F.explode("words").alias("word")).distinct().select("word", similarity.metaphone("word").alias("code"))


@query("str13_label_text", "SELECT row_id, CASE row_id % 4 WHEN 0 THEN '' WHEN 1 THEN '1, ' ELSE '0, ' || (row_id % 3) END AS labels, row_id % 4 > 1 AS two FROM names", "names")
def _(spark, d):
    k = F.col("row_id") % 4
    lab = F.when(k == 0, F.array().cast("array<int>")).when(k == 1, F.array(F.lit(1))).otherwise(F.array(F.lit(0), (F.col("row_id") % 3).cast("int")))
    out = _names(spark, d).select("row_id", text.join_labels(lab).alias("labels"))
    return out.select("row_id", "labels", (F.size(text.parse_labels(F.col("labels"))) == 2).alias("two"))


@query("str14_parse_literals", "SELECT row_id, CAST(row_id % 4 AS INTEGER) AS first, 2 AS n FROM names", "names")
def _(spark, d):
    lit = _names(spark, d).select("row_id", F.format_string("[%d, 7]", F.col("row_id") % 4).alias("label_list"))
    return readers.parse_nested(lit).select("row_id", F.col("label_list")[0].alias("first"), F.size("label_list").alias("n"))


@query("str15_hyphen_words")
def _(spark, d):
    rows = _variants(spark, d).filter("name is not null").withColumn("name", F.translate("name", " ", "-"))
    return nlp.nlp_features(rows, vector=None).select("row_id", _joined("pos"))


# --- numbers, arrays, lookups


@query("mth1_modified_idf", "SELECT fold, word, round(idf, 6) AS idf FROM idf", "idf")
def _(spark, d):
    return weights.idf_table(_folded(spark, d), _corpus(spark, d)).select("fold", "word", r6("idf"))


@query("mth2_weights", "SELECT row_id, word, round(tfidf, 6) AS tfidf FROM weights", "weights")
def _(spark, d):
    return _weights(spark, d).select("row_id", "word", r6("tfidf"))


@query("mth3_normalized", "SELECT row_id, word, round(normalized, 6) AS normalized FROM weights", "weights")
def _(spark, d):
    return _weights(spark, d).select("row_id", "word", r6("normalized"))


@query("mth4_min_max", "SELECT w.row_id, w.word, round((w.tfidf - b.low) / nullif(b.high - b.low, 0), 6) AS scaled FROM weights w, (SELECT min(tfidf) AS low, max(tfidf) AS high FROM weights) b", "weights")
def _(spark, d):
    rows = weights.scaled_weights(weights.weigh(_folded(spark, d), _corpus(spark, d)))
    pair = F.explode(F.arrays_zip(arrays.entry_values(F.col("tfidf"), "word").alias("word"), F.col("tfidf_scaled").alias("scaled"))).alias("p")
    return rows.select("row_id", pair).select("row_id", F.col("p.word").alias("word"), F.round("p.scaled", 6).alias("scaled"))


@query("mth5_min_max_column", "SELECT p_partkey, round((p_retailprice - low) / (high - low), 6) AS scaled FROM part, (SELECT min(p_retailprice) AS low, max(p_retailprice) AS high FROM part)")
def _(spark, d):
    p = _part(spark, d)
    bounds = p.agg(F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"))
    return p.crossJoin(F.broadcast(bounds)).select("p_partkey", F.round(arrays.min_max(F.col("p_retailprice"), F.col("low"), F.col("high")), 6).alias("scaled"))


@query("mth6_place_weights", "SELECT p_size AS n, i, round(1.0 / ((i + 1) * (i + 1)) * 85 / total, 6) AS weight FROM (SELECT DISTINCT p_size FROM part), (SELECT unnest(range(60)) AS i), LATERAL (SELECT sum(1.0 / ((k + 1) * (k + 1))) AS total FROM (SELECT unnest(range(p_size)) AS k)) WHERE i < p_size")
def _(spark, d):
    sizes = _part(spark, d).select(F.col("p_size").alias("n")).distinct().select("n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    return sizes.select("n", F.col("i").cast("long").alias("i"), F.round(arrays.place_weight(F.col("i"), F.col("n")), 6).alias("weight"))


@query("mth6_ordered_score", "SELECT row_id, ref_id, round(s0, 6) AS score FROM scored", "scored")
def _(spark, d):
    mine, pool = _sides(spark, d)
    a = mine.select("row_id", arrays.words_with_label(F.col("labels"), 0).alias("x"))
    b = pool.select(F.col("row_id").alias("ref_id"), arrays.words_with_label(F.col("labels"), 0).alias("y"))

    def at(c, i):
        return F.coalesce(F.get(c, F.lit(i)), F.lit(""))

    def scored(crossed):
        n = F.greatest(F.size("x"), F.size("y"))
        r = crossed.select("row_id", "ref_id", F.when(n > 0, similarity.ratio(at("y", 0), at("x", 0))).alias("r0"), F.when(n > 1, similarity.ratio(at("y", 1), at("x", 1))).alias("r1"))
        return r.select("row_id", "ref_id", F.round(similarity.ordered_score(F.array_compact(F.array("r0", "r1"))), 6).alias("score"))

    return pairs.all_pairs(a, b, "row_id", "ref_id", scored)


@query("mth7_argmax", "SELECT p_partkey, CASE WHEN p_size % 5 >= p_size % 3 AND p_size % 5 >= p_size % 7 THEN 0 WHEN p_size % 3 >= p_size % 7 THEN 1 ELSE 2 END AS k FROM part")
def _(spark, d):
    return _part(spark, d).select("p_partkey", arrays.argmax(F.array(F.col("p_size") % 5, F.col("p_size") % 3, F.col("p_size") % 7)).alias("k"))


@query("mth8_half_even", "SELECT p_partkey, round_even(p_size / 2.0, 0) AS x FROM part")
def _(spark, d):
    return _part(spark, d).select("p_partkey", arrays.half_even(F.col("p_size") / 2.0).alias("x"))


@query("arr1_first_n", "SELECT row_id, array_to_string(words[1:2], '|') AS words FROM worded", "worded")
def _(spark, d):
    return _worded(spark, d).select("row_id", F.array_join(arrays.first_n(F.col("words"), 2), "|").alias("words"))


@query("arr2_padded", "SELECT row_id, array_to_string(list_concat(words, ['-', '-', '-', '-', '-', '-'])[1:6], '|') AS words FROM worded", "worded")
def _(spark, d):
    return _worded(spark, d).select("row_id", F.array_join(arrays.pad_to(F.col("words"), F.lit("-"), 6), "|").alias("words"))


@query("arr3_plus_one", "SELECT row_id, array_to_string(list_transform(words, lambda w: length(w) + 1), '|') AS n FROM worded", "worded")
def _(spark, d):
    return _worded(spark, d).select("row_id", F.array_join(F.transform(arrays.plus_one(F.transform("words", F.length)), lambda x: x.cast("string")), "|").alias("n"))


@query("arr4_positions", "SELECT row_id, array_to_string(range(1, len(words) + 1), '|') AS p FROM worded", "worded")
def _(spark, d):
    return _worded(spark, d).select("row_id", F.array_join(F.transform(arrays.positions(F.col("words")), lambda x: x.cast("string")), "|").alias("p"))


@query("arr5_one_hot", "SELECT p_partkey, array_to_string(list_transform(range(4), lambda i: CAST(i = p_size % 4 AS INTEGER)), '') AS hot FROM part")
def _(spark, d):
    return _part(spark, d).select("p_partkey", F.array_join(F.transform(arrays.one_hot(F.col("p_size") % 4), lambda x: x.cast("string")), "").alias("hot"))


@query("arr6_decoded_labels", "SELECT row_id, word, label FROM labelled", "labelled")
def _(spark, d):
    return _labelled(spark, d).select("row_id", F.explode("labels").alias("l")).select("row_id", "l.word", "l.label")


@query("arr7_important_words", "SELECT row_id, array_to_string(imp, '|') AS words FROM lists", "lists")
def _(spark, d):
    return _labelled(spark, d).select("row_id", F.array_join(arrays.words_with_label(F.col("labels"), 0), "|").alias("words"))


@query("arr8_greedy_assignment", "SELECT p_partkey, CASE WHEN p_size % 10 >= p_size % 7 THEN 'a-x,b-y' ELSE 'a-y,b-x' END AS pairs FROM part")
def _(spark, d):
    # scores a-x: 2s, a-y: 2t + 1, b-x: 0, b-y: 0; the greatest goes first and decides the other
    s, t = F.col("p_size") % 10, F.col("p_size") % 7
    rows = [("a", "x", F.when(s >= t, 90).otherwise(10)), ("a", "y", F.when(s >= t, 20).otherwise(80)), ("b", "x", F.lit(5)), ("b", "y", F.lit(5))]
    pairs = F.array(*[F.struct(v.cast("int").alias("score"), F.lit(x).alias("word1"), F.lit(y).alias("word2")) for x, y, v in rows])
    got = F.array_sort(F.transform(similarity.greedy_pairs(pairs), lambda p: F.concat_ws("-", p["word1"], p["word2"])))
    return _part(spark, d).select("p_partkey", F.array_join(got, ",").alias("pairs"))


@query("arr9_distinct_words", "SELECT row_id, len(list_distinct(words)) AS n FROM worded", "worded")
def _(spark, d):
    return _worded(spark, d).select("row_id", F.size(F.array_distinct("words")).cast("long").alias("n"))


@query("arr10_is_separated", "SELECT DISTINCT row_id, is_separated FROM split", "split")
def _(spark, d):
    return names.split_names(_variants(spark, d)).select("row_id", "is_separated").distinct()


@query("map1_values", "SELECT row_id, array_to_string(list(word ORDER BY pos), '|') AS words FROM weights GROUP BY row_id", "weights")
def _(spark, d):
    return weights.weigh(_folded(spark, d), _corpus(spark, d)).select("row_id", F.array_join(arrays.entry_values(F.col("tfidf"), "word"), "|").alias("words"))


@query("map2_tag_codes", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 9 WHEN 1 THEN 13 WHEN 2 THEN 10 ELSE 17 END AS code FROM part")
def _(spark, d):
    k = F.col("p_size") % 4
    return _part(spark, d).select("p_partkey", arrays.pos_code(F.when(k == 0, "NOUN").when(k == 1, "PROPN").when(k == 2, "NUM").otherwise("VERB")).alias("code"))


@query("map3_label_names", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Important' WHEN 1 THEN 'Subsidiary' WHEN 2 THEN 'Generic' ELSE 'None' END AS label, p_size % 4 AS number FROM part")
def _(spark, d):
    label = arrays.label_name(F.col("p_size") % 4)
    return _part(spark, d).select("p_partkey", label.alias("label")).select("p_partkey", "label", arrays.label_number(F.col("label")).alias("number"))


@query("map4_label_tiles", """SELECT row_id, string_agg('<span style="background:' || ['#2e7d32', '#1565c0', '#9e9e9e'][label + 1] || '">' || replace(replace(replace(word, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</span>', ' ' ORDER BY i) AS html
    FROM labelled GROUP BY row_id""", "labelled")
def _(spark, d):
    return _labelled(spark, d).select("row_id", arrays.tiles(F.col("labels")).alias("html"))


# --- models, scorers, flows


@query("udf1_word_vectors")
def _(spark, d):
    rows = nlp.nlp_features(_names(spark, d))
    return rows.select("row_id", F.posexplode("word_vecs").alias("place", "v")).select("row_id", "place", F.size("v").alias("size"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm"))


@query("udf1_trained_vectors")
def _(spark, d):
    return nlp.fit_word_vectors(_worded(spark, d), 16).getVectors().select("word", F.lit(16).alias("size"))


@query("udf2_parts_of_speech")
def _(spark, d):
    return nlp.nlp_features(_names(spark, d), vector=None).select("row_id", _joined("pos"))


@query("udf4_labeler_trained_and_applied")
def _(spark, d):
    rows = labels.position_labeler()(_raw(spark, d))
    path = _place(spark, "labeler")
    labels.save_labeler(labels.train_labeler(rows.filter("row_id % 5 <> 0"), 512), path)
    held = labels.model_labeler(labels.load_labeler(path))(rows.filter("row_id % 5 = 0").select("row_id", "words"))
    return held.select("row_id", F.array_join(F.transform("label_list", lambda x: x.cast("string")), ",").alias("labels"))


_GUESS = "CASE WHEN i = 1 THEN 0 WHEN word IN ('red', 'blue', 'RED', 'BLUE') OR length(word) > 6 THEN 2 WHEN length(word) = 3 THEN 1 ELSE 0 END"


@query("udf5_evaluation", f"SELECT round(avg(CAST(label = {_GUESS} AS DOUBLE)), 6) AS accuracy FROM tokens", "tokens")
def _(spark, d):
    """Labels by rules of words and places, held against labels by position."""
    tokens = labels.token_features(labels.position_labeler()(_raw(spark, d)))
    w, n = F.col("word"), F.length("word")
    guess = F.when(F.col("place") == 0, 0).when(w.isin("red", "blue", "RED", "BLUE") | (n > 6), 2).when(n == 3, 1).otherwise(0)
    return evaluate.token_accuracy(tokens.withColumn("prediction", guess.cast("double"))).select(r6("accuracy"))


@query("udf5_trained_evaluation")
def _(spark, d):
    """Accuracy of both kinds of trained labelers on tokens of names that they haven't seen."""
    rows = labels.position_labeler()(_raw(spark, d))
    seen, held = rows.filter("row_id % 5 <> 0"), labels.token_features(rows.filter("row_id % 5 = 0"))
    out = None
    for kind, model in (("regression", labels.train_labeler(seen, 256)), ("network", labels.train_labeler(seen, 64, hidden=(16,)))):
        one = evaluate.token_accuracy(model.transform(held)).select(F.lit(kind).alias("model"), "accuracy")
        out = one if out is None else out.union(one)
    return out


@query("udf3_token_predictions", "SELECT row_id, count(*) AS n FROM tokens WHERE row_id % 5 = 0 GROUP BY row_id", "tokens")
def _(spark, d):
    """A label for each token of held-out names; the SQL tells how many."""
    rows = labels.position_labeler()(_raw(spark, d))
    model = labels.train_labeler(rows.filter("row_id % 5 <> 0"), 256)
    out = labels.model_labeler(model)(rows.filter("row_id % 5 = 0").select("row_id", "words"))
    return out.select("row_id", F.size(F.filter("label_list", lambda k: k.between(0, 2))).cast("long").alias("n"))


_WORDED = """SELECT a, b, r, length(a) % 3 AS la, length(b) % 3 AS lb, 1 + length(a) % 2 AS ia, 1 + length(b) % 2 AS ib, 1 + length(a) % 4 AS sa, 1 + length(b) % 4 AS sb, length(b) % 5 = 0 AS single
    FROM ratios WHERE a <> '' AND b <> ''"""


@query("udf8_older_word_scores", f"""SELECT a, b, round(CASE WHEN single AND la = 0 AND lb = 0 THEN s WHEN la = lb THEN s * [0.85, 0.1, 0.05][la + 1] / greatest(1, sa, sb)
    WHEN la + lb = 1 THEN s * 0.85 / (CASE WHEN la = 0 THEN ia ELSE ib END) ELSE s END, 6) AS score
    FROM (SELECT *, CASE WHEN r >= 95 THEN r / 100.0 ELSE 0.0 END AS s FROM ({_WORDED}))""", "ratios")
def _(spark, d):
    """All pairs of important words, with labels and counts made of their lengths."""
    v = _vocab(spark, d).filter("word <> ''")
    pairs = v.select(F.col("word").alias("a")).crossJoin(v.select(F.col("word").alias("b"))).withColumn("r", similarity.ratio("a", "b"))
    na, nb = F.length("a"), F.length("b")
    s = wordscores.weighted_word_scores(F.col("r"), na % 3, nb % 3, 1 + na % 2, 1 + nb % 2, 1 + na % 4, 1 + nb % 4, nb % 5 == 0)
    return pairs.select("a", "b", F.round(s, 6).alias("score"))


@query("udf6_pair_scores", "SELECT row_id, ref_id, round(score, 6) AS score, category FROM scored", "scored")
def _(spark, d):
    mine, pool = (match._lists(x) for x in _sides(spark, d))
    a = mine.select("row_id", *[F.col(c).alias(f"l{c}") for c in match.LISTS])
    b = pool.select(F.col("row_id").alias("ref_id"), *[F.col(c).alias(f"r{c}") for c in match.LISTS])
    s = match.pair_score()(*[F.col(f"r{c}") for c in match.LISTS], *[F.col(f"l{c}") for c in match.LISTS])

    def scored(crossed):
        return crossed.withColumn("s", s).select("row_id", "ref_id", F.round("s.score", 6).alias("score"), "s.category")

    return pairs.all_pairs(a, b, "row_id", "ref_id", scored)


@query("udf7_older_name_scores_spot_check")
def _(spark, d):
    mine, pool = _sides(spark, d)
    a = mine.filter("row_id % 90 = 0").select("row_id", F.col("labels").alias("x"))
    b = pool.filter("row_id % 10 = 1").select(F.col("row_id").alias("ref_id"), F.col("labels").alias("y"))

    def scored(crossed):
        return crossed.select("row_id", "ref_id", F.round(wordscores.name_scores()("x", "y"), 6).alias("score"))

    return pairs.all_pairs(a, b, "row_id", "ref_id", scored)


@query("stm1_streamed_matches", "SELECT row_id, ref_id, round(score, 6) AS score, category FROM best", "best")
def _(spark, d):
    """Rows arrive as a stream; the result is the same as in one batch."""
    place = _place(spark, "stream")
    _short(spark, d).filter("source = 'inference'").write.parquet(f"{place}/in")
    arriving = spark.readStream.schema("row_id long, name string, source string").parquet(f"{place}/in")
    pool = _sides(spark, d)[1]

    def sink(df, number):
        df.select("row_id", F.col("matched_id").alias("ref_id"), r6("score"), "category").write.mode("overwrite").parquet(f"{place}/out/batch={number}")

    match_stream(arriving, pool, sink, f"{place}/state", labels.position_labeler()).awaitTermination()
    return spark.read.parquet(f"{place}/out").drop("batch")


@query("flow_weights", "SELECT row_id, word, round(tf, 6) AS tf, round(idf, 6) AS idf, round(tfidf, 6) AS tfidf, round(normalized, 6) AS normalized FROM weights", "weights")
def _(spark, d):
    return _weights(spark, d).select("row_id", "word", r6("tf"), r6("idf"), r6("tfidf"), r6("normalized"))


@query("flow_report", "SELECT * FROM flow", "flow")
def _(spark, d):
    out = report.report(_linked(spark, d), _active(spark, d), LinkConfig())
    return out.withColumn("Match Score", F.round("Match Score", 6))
