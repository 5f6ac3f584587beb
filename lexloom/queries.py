"""The registered queries of the library over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions import text as fn
from lexloom.functions.rules import DOUBLING, SOUND_FOLDS, SUFFIX_RULES
from lexloom.operators import align, evaluate, features, graph, lexicon, picker, screen, search
from lexloom.plans import serving
from lexloom.sources import books
from lexloom.sources.scratch import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of files whose rows are worked on in one task.
TASK_BYTES = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """A table that arrives in fewer parts than there are cores (one small file) is dealt out before costly expressions."""
    spark = df.sparkSession
    small = sum(_sizes(spark, df.inputFiles())) < spark.sparkContext.defaultParallelism * (128 << 20)
    return df.repartition(spark.sparkContext.defaultParallelism) if small else df


def _sizes(spark: SparkSession, files: list[str]) -> list[int]:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(f) for f in files[:10_000]]
    return [p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths]


#: Stop list of the demonstration queries; real ones are a table.
STOP = sorted({"the", "of", "and", "to", "in", "is", "that", "with", "der", "die", "das", "und", "les", "des", "de", "la", "que", "los", "las", "el", "en"})
_STOP_SQL = ", ".join(f"('{w}')" for w in STOP)
_KEY = r"trim(regexp_replace(replace(lower(translate({}, '’‘ʼ_', ''''''' ')), 'ß', 'ss'), '[ \t\n\x0B\f\r]+', ' ', 'g'))"
_TOKENS = r"regexp_extract_all(coalesce({}, ''), '[\p{{L}}\p{{Nl}}\p{{No}}]+(?:[''’][\p{{L}}\p{{Nl}}\p{{No}}]+)*')"
_CONTENT = f"""tok AS (SELECT id, ord, {_KEY.format("token")} AS key FROM (SELECT doc_id AS id, unnest(range(len(t))) AS ord, unnest(t) AS token FROM (SELECT doc_id, {_TOKENS.format("text")} AS t FROM documents))),
stop(key) AS (VALUES {_STOP_SQL}),
content AS (SELECT id, key, min(ord) AS ord, count(*) AS tf FROM tok WHERE length(key) >= 2 AND key NOT IN (SELECT key FROM stop) GROUP BY id, key)"""


def stop_table(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.range(1).select(F.explode(F.array(*[F.lit(w) for w in STOP])).alias("key")))


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are dealt out by id before they are cut into words, so that what is counted per document stays where it is."""
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    files = texts.inputFiles()
    known = _sizes(spark, files)
    tasks = max(spark.sparkContext.defaultParallelism, -(-sum(known) * len(files) // max(1, len(known)) // TASK_BYTES))
    return features.content_keys(texts.repartition(tasks, "doc_id"), stop_table(spark), "doc_id")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: keys of the documents by document frequency."""
    return features.document_frequency(content(spark, sf_dir), table(spark, sf_dir, "documents"))


@register(f"SELECT p_partkey, {_KEY.format('p_name')} AS key FROM part")
def lookup_key_norm(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", fn.lookup_key(F.col("p_name")).alias("key"))


@register(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n, md5(array_to_string(t, ' ')) AS words_md5 FROM (SELECT doc_id, {_TOKENS.format('text')} AS t FROM documents)")
def tokenise_count(spark, sf_dir):
    own = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", fn.tokens(F.col("text")).alias("t"))
    return own.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("words_md5"))


@register(f"WITH {_CONTENT} SELECT id, count(*) AS n_keys, CAST(sum(tf) AS BIGINT) AS n_tokens, min(ord) AS first_at FROM content GROUP BY id")
def stop_filtered_tokens(spark, sf_dir):
    return content(spark, sf_dir).groupBy("id").agg(F.count(F.lit(1)).alias("n_keys"), F.sum("tf").alias("n_tokens"), F.min("ord").cast("long").alias("first_at"))


@register(f"WITH {_CONTENT}, n AS (SELECT count(*) AS n FROM documents) SELECT key, count(*) AS df, CAST(floor((ln((any_value(n) + 1.0::DOUBLE) / (count(*) + 1.0::DOUBLE)) + 1.0::DOUBLE) * 10000 + 0.5::DOUBLE) AS BIGINT) AS idf4 FROM content, n GROUP BY key HAVING count(*) >= 2")
def doc_freq_idf(spark, sf_dir):
    return features.document_frequency(content(spark, sf_dir), table(spark, sf_dir, "documents"))


@register(f"WITH {_CONTENT} SELECT id, key, w, size, rank FROM (SELECT id, key, tf * 10 AS w, count(*) OVER (PARTITION BY id) AS size, row_number() OVER (PARTITION BY id ORDER BY tf DESC, key DESC) AS rank FROM content) WHERE rank <= 60")
def signature_top60(spark, sf_dir):
    weights = content(spark, sf_dir).select("id", "key", (F.col("tf") * 10).alias("w"))
    return features.signature(weights, 60).withColumn("rank", F.col("rank").cast("long"))


@register(
    f"""WITH {_CONTENT},
ctok AS (SELECT conv_id, {_KEY.format("token")} AS key FROM (SELECT conv_id, unnest({_TOKENS.format("text")}) AS token FROM conversations)),
cw AS (SELECT conv_id, key, count(*) AS cw FROM ctok GROUP BY conv_id, key),
dot AS (SELECT conv_id, id, CAST(sum(cw * tf) AS BIGINT) AS dot FROM cw JOIN content USING (key) GROUP BY conv_id, id)
SELECT conv_id, id, dot, rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY dot DESC, id) AS rank FROM dot) WHERE rank <= 3"""
)
def sparse_dot(spark, sf_dir):
    """The three documents with the highest dot product per conversation, over all content keys."""
    conv = features.keys(table(spark, sf_dir, "conversations"), "conv_id").groupBy("id", "key").agg(F.count(F.lit(1)).alias("w"))
    docs = content(spark, sf_dir).select("id", "key", F.col("tf").alias("w"))
    return features.top_products(conv, docs, 3).select(F.col("l_id").alias("conv_id"), F.col("r_id").alias("id"), "dot", "rank")


@register("SELECT doc_id, source, rank, 2.0::DOUBLE / rank AS prior, rank = 1 AS best FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents)")
def sense_rank_prior(spark, sf_dir):
    by = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    own = table(spark, sf_dir, "documents").withColumn("rank", F.row_number().over(by).cast("long"))
    return own.select("doc_id", "source", "rank", (F.lit(2.0) / F.col("rank")).alias("prior"), (F.col("rank") == 1).alias("best"))


@register(
    f"""WITH tok AS (SELECT conv_id, turn, unnest(range(len(t))) AS j, unnest(t) AS token FROM (SELECT conv_id, turn, {_TOKENS.format("text")} AS t FROM conversations)),
k AS (SELECT conv_id, turn, j, {_KEY.format("token")} AS key FROM tok),
c AS (SELECT *, lag(key) OVER w AS prev, lead(key) OVER w AS next, row_number() OVER (PARTITION BY conv_id, turn, key ORDER BY j) AS nth FROM k WINDOW w AS (PARTITION BY conv_id, turn ORDER BY j))
SELECT conv_id, turn, j, key, prev, next FROM c WHERE nth = 1"""
)
def clue_nearest(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(fn.tokens(F.col("text"))).alias("j", "token"))
    own = own.withColumn("key", fn.lookup_key(F.col("token")))
    by = Window.partitionBy("conv_id", "turn")
    own = own.withColumns({"prev": F.lag("key").over(by.orderBy("j")), "next": F.lead("key").over(by.orderBy("j"))})
    own = own.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id", "turn", "key").orderBy("j"))).filter("nth = 1")
    return own.select("conv_id", "turn", F.col("j").cast("long").alias("j"), "key", "prev", "next")


@register(
    """WITH s AS (SELECT o_custkey AS g, o_orderkey AS target, floor(o_totalprice / 1000) / 100 AS score, floor(o_totalprice / 2000) / 100 AS part, o_orderkey AS ord FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, ord) AS place FROM s),
t AS (SELECT r.*, b.target AS bt, b.score AS bs, b.part AS bp, b.ord AS bo FROM r JOIN (SELECT * FROM r WHERE place = 1) b USING (g)),
a AS (SELECT g, any_value(bt) AS target, any_value(bs) AS score, any_value(bp) AS part, max(CASE WHEN place = 2 THEN score END) AS second, max(CASE WHEN place > 1 AND (bs - score < 0.2::DOUBLE OR (ord < bo AND bs < 1.5::DOUBLE * score)) THEN 1 ELSE 0 END) AS beaten FROM t GROUP BY g)
SELECT g AS "group", target, score, second, CASE WHEN score < 1.0 OR part < 0.4::DOUBLE THEN 'below_threshold' WHEN beaten = 1 THEN 'tie' ELSE 'aligned' END AS verdict FROM a"""
)
def decide_best(spark, sf_dir):
    price = F.col("o_totalprice")
    s = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("group"), F.col("o_orderkey").alias("target"), (F.floor(price / 1000) / 100).alias("score"), (F.floor(price / 2000) / 100).alias("part"), F.col("o_orderkey").alias("ord"))
    return align.decide(s)


_EDGES = """edges AS (SELECT 'N' || n_nationkey AS src, 'hypernym' AS rel, 'R' || n_regionkey AS dst FROM nation UNION ALL SELECT 'R' || n_regionkey, 'hyponym', 'N' || n_nationkey FROM nation
UNION ALL SELECT 'S' || s_suppkey, 'similar', 'N' || s_nationkey FROM supplier UNION ALL SELECT 'N' || s_nationkey, 'similar', 'S' || s_suppkey FROM supplier)"""


@register(
    f"""WITH {_EDGES}, ways AS (SELECT src, dst, 1 AS p, 'similar' AS label FROM edges WHERE rel IN ('similar', 'also')
UNION ALL SELECT a.src, b.dst, 2, 'similar' FROM edges a JOIN edges b ON a.dst = b.src AND a.rel IN ('similar', 'also') AND b.rel = 'similar'
UNION ALL SELECT src, dst, 3, 'hypernym' FROM edges WHERE rel = 'hypernym' UNION ALL SELECT src, dst, 4, 'hyponym' FROM edges WHERE rel = 'hyponym'
UNION ALL SELECT a.src, b.src, 5, 'sibling' FROM edges a JOIN edges b ON a.dst = b.dst AND a.rel = 'hypernym' AND b.rel = 'hypernym')
SELECT src, dst, arg_min(label, p) AS label FROM ways WHERE src <> dst GROUP BY src, dst"""
)
def near_relation(spark, sf_dir):
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    up = n.select(name("N", "n_nationkey").alias("src"), F.lit("hypernym").alias("rel"), name("R", "n_regionkey").alias("dst"))
    down = n.select(name("R", "n_regionkey"), F.lit("hyponym"), name("N", "n_nationkey"))
    satellite, head = name("S", "s_suppkey"), name("N", "s_nationkey")
    return graph.near(up.union(down).union(s.select(satellite, F.lit("similar"), head)).union(s.select(head, F.lit("similar"), satellite)))


@register(
    """WITH w AS (SELECT c_nationkey AS id, split_part(c_mktsegment, ' ', 1) AS key, 100 AS w, c_custkey AS ord, 'member' AS how FROM customer UNION ALL SELECT n_nationkey, n_name, 60, 0, 'hypernym' FROM nation
UNION ALL SELECT s_nationkey, s_name, 40, s_suppkey, 'hyponym' FROM supplier UNION ALL SELECT c_nationkey, c_mktsegment, 100, -c_custkey - 1, 'own' FROM customer)
SELECT id, key, arg_max(w, (w, -ord)) AS w, arg_max(how, (w, -ord)) AS how FROM w GROUP BY id, key"""
)
def neighbourhood_max_merge(spark, sf_dir):
    c, n, s = (table(spark, sf_dir, t) for t in ("customer", "nation", "supplier"))
    rows = c.select(F.col("c_nationkey").alias("id"), F.substring_index("c_mktsegment", " ", 1).alias("key"), F.lit(100).alias("w"), F.col("c_custkey").alias("ord"), F.lit("member").alias("how"))
    rows = rows.union(n.select("n_nationkey", "n_name", F.lit(60), F.lit(0).cast("long"), F.lit("hypernym")))
    rows = rows.union(s.select("s_nationkey", "s_name", F.lit(40), "s_suppkey", F.lit("hyponym"))).union(c.select("c_nationkey", "c_mktsegment", F.lit(100), -F.col("c_custkey") - 1, F.lit("own")))
    return features.max_merge(rows, ["id", "key"])


@register(
    """SELECT 'lineitem_order' AS name, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'order_customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'customer_without_order', count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"""
)
def integrity_orphans(spark, sf_dir):
    li, o, c = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    parts = [("lineitem_order", graph.orphans(li, "l_orderkey", o, "o_orderkey")), ("order_customer", graph.orphans(o, "o_custkey", c, "c_custkey")), ("customer_without_order", graph.orphans(c, "c_custkey", o, "o_custkey"))]
    out = None
    for name, rows in parts:
        n = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.union(n)
    return out


@register("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) = 0")
def having_no_support(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("bad")).filter("bad = 0").drop("bad")


@register("SELECT l_orderkey, l_partkey, min(l_linenumber) AS rank FROM lineitem GROUP BY l_orderkey, l_partkey")
def keep_lowest_rank(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("rank"))


@register("SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 4")
def top_k_per_group(spark, sf_dir):
    by = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(by).cast("long").alias("rank")).filter("rank <= 4")


@register("SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order FROM orders GROUP BY o_custkey")
def first_example(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"))


def _sound_sql(column: str) -> str:
    x = f"regexp_replace(lower({column}), '[^a-z]', '', 'g')"
    for pattern, by in SOUND_FOLDS:
        x = f"regexp_replace({x}, '{pattern}', '{by.replace('$', chr(92))}', 'g')"
    return x


def _collapse_sql(x: str) -> str:
    for c in "abcdefghijklmnopqrstuvwxyzSCT":
        x = f"regexp_replace({x}, '{c}+', '{c}', 'g')"
    return x


_WORDS_SQL = f"SELECT DISTINCT {_KEY.format('token')} AS word FROM (SELECT unnest({_TOKENS.format('p_name')}) AS token FROM part UNION ALL SELECT unnest({_TOKENS.format('text')}) FROM benchmark UNION ALL SELECT unnest({_TOKENS.format('text')}) FROM documents)"


#: Words that are asked for, against all words.
_ASKED_SQL = f"SELECT DISTINCT {_KEY.format('token')} AS word FROM (SELECT unnest({_TOKENS.format('p_name')}) AS token FROM part UNION ALL SELECT unnest({_TOKENS.format('text')}) FROM benchmark)"


def word_list(spark: SparkSession, sf_dir: str, asked: bool = False) -> DataFrame:
    """The distinct words of all part names, test items and documents; ``asked``: of names and items only."""
    part, bench = table(spark, sf_dir, "part"), table(spark, sf_dir, "benchmark")
    both = part.select(F.explode(fn.tokens(F.col("p_name"))).alias("token")).union(bench.select(F.explode(fn.tokens(F.col("text")))))
    if not asked:
        both = both.union(spread(table(spark, sf_dir, "documents").select("text")).select(F.explode(fn.tokens(F.col("text")))))
    # Keys are made of the distinct tokens; a query that uses the list more than once does not read the documents again.
    return cut(both.distinct().select(fn.token_key(F.col("token")).alias("word")).distinct(), "words")


@register(f"WITH v AS ({_WORDS_SQL}), f AS (SELECT word, {_sound_sql('word')} AS x FROM v) SELECT word, {_collapse_sql('''regexp_replace(substr(x, 1, 1), '[aeiouy]', 'a') || regexp_replace(substr(x, 2), '[aeiouyhw]', '', 'g')''')} AS sound FROM f")
def sound_keys(spark, sf_dir):
    return word_list(spark, sf_dir).select("word", fn.sound_key(F.col("word")).alias("sound"))


@register(
    f"""WITH v AS ({_WORDS_SQL}), q AS (SELECT DISTINCT left(word, 3) AS query FROM v WHERE length(word) >= 3)
SELECT query, word AS key, place FROM (SELECT query, word, row_number() OVER (PARTITION BY query ORDER BY length(word), word) AS place FROM q JOIN v ON left(word, 3) = query) WHERE place <= 8"""
)
def completions(spark, sf_dir):
    v = word_list(spark, sf_dir)
    q = v.filter(F.length("word") >= 3).select(F.left("word", F.lit(3)).alias("query"))
    return search.completions(q, v.select(F.col("word").alias("key"))).withColumn("place", F.col("place").cast("long"))


_SOUND_OF = _collapse_sql("regexp_replace(substr(x, 1, 1), '[aeiouy]', 'a') || regexp_replace(substr(x, 2), '[aeiouyhw]', '', 'g')")


@register(
    f"""WITH v0 AS (SELECT * FROM ({_WORDS_SQL}) WHERE regexp_full_match(word, '[a-z]+')), f AS (SELECT word, {_sound_sql("word")} AS x FROM v0), v AS (SELECT word, {_SOUND_OF} AS sound FROM f), q AS (SELECT * FROM v WHERE length(word) >= 4 AND word IN ({_ASKED_SQL})),
w AS (SELECT q.word AS query, v.word AS key, 0 AS kind, levenshtein(q.word, v.word) AS d, length(v.word) AS n FROM q JOIN v ON q.sound = v.sound AND q.sound <> ''
UNION ALL SELECT q.word, v.word, 1, levenshtein(q.word, v.word), 0 FROM q JOIN v ON left(q.word, 1) = left(v.word, 1) AND abs(length(q.word) - length(v.word)) <= 2 AND levenshtein(q.word, v.word) <= greatest(1, length(q.word) // 3)),
b AS (SELECT query, key, min((kind, d, n)) AS r FROM w WHERE key <> query GROUP BY query, key)
SELECT query, key, place FROM (SELECT query, key, row_number() OVER (PARTITION BY query ORDER BY r, key) AS place FROM b) WHERE place <= 5"""
)
def near_spelling(spark, sf_dir):
    v = word_list(spark, sf_dir).filter(F.col("word").rlike("^[a-z]+$"))
    asked = word_list(spark, sf_dir, asked=True).filter(F.col("word").rlike("^[a-z]+$") & (F.length("word") >= 4))
    out = search.suggestions(asked.select(F.col("word").alias("query")), v.select(F.col("word").alias("key")))
    return out.withColumn("place", F.col("place").cast("long"))


def _suffix_sql() -> str:
    parts = []
    for i, (pos, suffix, by) in enumerate(SUFFIX_RULES):
        stem = f"left(word, length(word) - {len(suffix)})"
        parts.append(f"SELECT word, '{pos}' AS pos, {2 * i} AS ord, {stem} || '{by}' AS lemma FROM v WHERE ends_with(word, '{suffix}')")
        if suffix in DOUBLING.get(pos, ()) and not by:
            parts.append(f"SELECT word, '{pos}', {2 * i + 1}, left(word, length(word) - {len(suffix) + 1}) FROM v WHERE ends_with(word, '{suffix}') AND length({stem}) >= 3 AND substr({stem}, -1, 1) = substr({stem}, -2, 1) AND NOT regexp_matches(substr({stem}, -1, 1), '[aeiousy]')")
    return " UNION ALL ".join(parts)


@register(
    f"""WITH v AS ({_WORDS_SQL}), c AS ({_suffix_sql()}), d AS (SELECT word AS lemma, pos FROM v, (VALUES ('n'), ('v'), ('a'), ('r')) p(pos)),
w AS (SELECT v.word, d.pos, d.lemma, 0 AS ord FROM v JOIN d ON v.word = d.lemma UNION ALL SELECT c.word, c.pos, c.lemma, c.ord + 1000 FROM c JOIN d ON c.lemma = d.lemma AND c.pos = d.pos WHERE length(c.lemma) >= 2)
SELECT word, pos, lemma, min(ord) AS ord FROM w GROUP BY word, pos, lemma"""
)
def suffix_lemmatise(spark, sf_dir):
    v = word_list(spark, sf_dir)
    lemmas = v.select(F.col("word").alias("lemma"), F.explode(F.array(*[F.lit(p) for p in "nvar"])).alias("pos"))
    return lexicon.lemmatise(v, lemmas)


@register(f"WITH {_CONTENT} SELECT key FROM content JOIN labels ON id = doc_id GROUP BY key HAVING bool_and(toxic = 1)")
def bad_words(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    own = content(spark, sf_dir)
    return screen.bad_words(own.join(labels, own.id == labels.doc_id).select("key", (F.col("toxic") == 1).alias("unfit")))


@register(
    """WITH h AS (SELECT source, count(*) AS n, CAST(sum(quality) AS BIGINT) AS k FROM documents JOIN labels USING (doc_id) GROUP BY source), p AS (SELECT *, k::DOUBLE / n::DOUBLE AS p, n::DOUBLE AS m FROM h)
SELECT source, n, k, floor(1e9 * ((p + 3.8416::DOUBLE / (2.0::DOUBLE * m)) / (1.0::DOUBLE + 3.8416::DOUBLE / m) - 1.96::DOUBLE * sqrt(p * (1.0::DOUBLE - p) / m + 3.8416::DOUBLE / (4.0::DOUBLE * m * m)) / (1.0::DOUBLE + 3.8416::DOUBLE / m)) + 0.5) AS low FROM p"""
)
def wilson_accuracy(spark, sf_dir):
    hits = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return evaluate.accuracy(hits, ["source"], F.col("quality")).select("source", "n", "k", F.floor(F.col("low") * 1e9 + 0.5).cast("double").alias("low"))


@register(
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
j AS (SELECT *, greatest(1, least((n + 1) * 9 // 10, n - 1)) AS j FROM r), t AS (SELECT event_type, any_value(n) AS n, any_value(j) AS j, max(CASE WHEN r = j THEN value END) AS a, max(CASE WHEN r = j + 1 THEN value END) AS b FROM j GROUP BY event_type)
SELECT event_type, (a * (10 - (n * 9 + 9 - j * 10)) + b * (n * 9 + 9 - j * 10)) / 10 AS value FROM t"""
)
def exclusive_p90(spark, sf_dir):
    return evaluate.exclusive_quantile(table(spark, sf_dir, "events"), ["event_type"], "value", 9)


@register(
    r"""WITH l AS (SELECT doc_id AS id, unnest(range(len(l))) AS line, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
p AS (SELECT id, line, text, sum(CASE WHEN regexp_matches(text, '^[^ ]+\.$') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY line) AS par FROM l),
h AS (SELECT *, last_value(CASE WHEN regexp_matches(text, '^[^ ]+\.$') THEN text END IGNORE NULLS) OVER (PARTITION BY id ORDER BY line ROWS UNBOUNDED PRECEDING) AS section FROM p)
SELECT id, CAST(par AS BIGINT) AS par, section, count(*) AS n_lines, CAST(sum(length(text)) AS BIGINT) AS chars FROM h GROUP BY id, par, section"""
)
def heading_sections(spark, sf_dir):
    rows = books.lines(table(spark, sf_dir, "documents"), "doc_id", "text").filter("text is not null")
    is_head = F.col("text").rlike(r"^[^ ]+\.$")
    by = Window.partitionBy("id").orderBy("line")
    rows = books.fill_headings(rows, is_head).withColumn("par", F.sum(F.when(is_head, 1).otherwise(0)).over(by))
    return rows.groupBy("id", "par", "section").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("text")).alias("chars"))


@register("SELECT page_id, CASE WHEN page_id % 7 <> 0 THEN md5(replace(html, chr(13) || chr(10), chr(10)) || chr(10)) END AS body_md5, CASE WHEN page_id % 7 <> 0 THEN length(replace(html, chr(13) || chr(10), chr(10))) + 1 END AS chars FROM pages")
def marker_clip(spark, sf_dir):
    """Pages put between marker lines (every seventh without its end) and clipped again."""
    end = F.when(F.col("page_id") % 7 == 0, "\r\nno end").otherwise("\r\n*** END of it\r\nfoot")
    own = table(spark, sf_dir, "pages").select("page_id", books.clip(F.concat(F.lit("\ufeffhead\r\n*** START of it\r\n"), "html", end), r"\*\*\* START", r"\*\*\* END").alias("x"))
    return own.select("page_id", F.md5("x").alias("body_md5"), F.length("x").cast("long").alias("chars"))


# The engine has no look-ahead, so the letter after a sentence is put back behind the mark.
@register(
    r"""WITH m AS (SELECT doc_id, regexp_replace(regexp_replace(text, '([.!?]["''’”)\]]*)\s+([^\p{Ll}\s]|$)', '\1' || chr(1) || '\2', 'g'), '\n[ \t]*\n', chr(1), 'g') AS t FROM documents),
s AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(1)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS s FROM m)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n, list_max(list_transform(s, lambda x: length(x))) AS longest FROM s"""
)
def sentence_split(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", books.sentences(F.col("text")).alias("s"))
    return own.select("doc_id", F.size("s").cast("long").alias("n"), F.array_max(F.transform("s", lambda x: F.length(x))).cast("long").alias("longest"))


@register("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_edge(spark, sf_dir):
    own = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long")["k"].alias("k"))
    return own.groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"))


@register(
    """WITH f AS (SELECT unnest(['n', 'v', 'a']) AS pos), w AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS lemma FROM part WHERE p_name IS NOT NULL),
x AS (SELECT lemma, pos, left(lemma, length(lemma) - 1) AS body, right(lemma, 1) AS z FROM w, f WHERE lemma <> ''),
e AS (SELECT lemma, pos, unnest(CASE pos WHEN 'n' THEN [lemma || 's', lemma || 'es', lemma || '''s', CASE WHEN z = 'y' THEN body || 'ies' END]
 WHEN 'v' THEN [lemma || 's', lemma || 'es', lemma || '''s', CASE WHEN z = 'y' THEN body || 'ies' END, lemma || 'ed', lemma || 'd', lemma || 'ing', lemma || z || 'ed', lemma || z || 'ing', CASE WHEN z = 'e' THEN body || 'ing' END, CASE WHEN z = 'y' THEN body || 'ied' END]
 ELSE [lemma || 'er', lemma || 'est', lemma || 'r', lemma || 'st', lemma || z || 'er', lemma || z || 'est', CASE WHEN z = 'y' THEN body || 'ier' END, CASE WHEN z = 'y' THEN body || 'iest' END] END) AS form FROM x)
SELECT DISTINCT form, lemma AS key FROM e WHERE form IS NOT NULL AND form <> lemma"""
)
def form_table(spark, sf_dir):
    w = table(spark, sf_dir, "part").select(F.lower(F.substring_index("p_name", " ", 1)).alias("lemma")).filter("lemma != ''").distinct()
    return lexicon.form_table(w.select("lemma", F.explode(F.array(*[F.lit(p) for p in "nva"])).alias("pos")))


@register(
    f"""WITH v AS ({_WORDS_SQL}), e AS (SELECT word, unnest([CASE WHEN contains(word, 'or') THEN regexp_replace(word, '^(.*?)or', '\\1our') END, CASE WHEN ends_with(word, 'er') THEN regexp_replace(word, 'er$', 're') END,
CASE WHEN contains(word, 'gray') THEN replace(word, 'gray', 'grey') END, CASE WHEN ends_with(word, 'og') THEN word || 'ue' END]) AS variant FROM v) SELECT word, variant FROM e WHERE variant IS NOT NULL"""
)
def british_forms(spark, sf_dir):
    return word_list(spark, sf_dir).select("word", F.explode(fn.british_variants(F.col("word"))).alias("variant"))


@register(
    f"""WITH v AS ({_WORDS_SQL}) SELECT word, CASE WHEN word = 'thorin' THEN false ELSE word IN ('idiot', 'ther') OR contains(word, 'thor') END AS blocked FROM v"""
)
def blocked_words(spark, sf_dir):
    return word_list(spark, sf_dir).select("word", fn.blocked(F.col("word"), ["idiot", "ther"], ["ther"], ["thor"], ["thorin"]).alias("blocked"))


@register(
    """WITH r AS (SELECT l_suppkey AS synset, 'p' || (l_partkey % 40) AS key, CASE l_returnflag WHEN 'A' THEN 'book2' WHEN 'R' THEN 'book1' ELSE 'base' END AS source, floor(l_quantity / 10) AS score FROM lineitem),
o AS (SELECT synset, key, source, max(score) AS score FROM r GROUP BY synset, key, source),
a AS (SELECT synset, key, CAST(floor(1e6 * sum(CASE source WHEN 'base' THEN 3.0::DOUBLE ELSE least(score, 3.0) / 3.0::DOUBLE + 0.5::DOUBLE END) + 0.5) AS BIGINT) AS agree, count(*) AS n FROM o GROUP BY synset, key)
SELECT synset, key, place FROM (SELECT synset, key, row_number() OVER (PARTITION BY synset ORDER BY agree DESC, length(key), key) AS place FROM a) WHERE place <= 6"""
)
def agree_synonyms(spark, sf_dir):
    source = F.when(F.col("l_returnflag") == "A", "book2").when(F.col("l_returnflag") == "R", "book1").otherwise("base")
    key = F.concat(F.lit("p"), (F.col("l_partkey") % 40).cast("string"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("synset"), key.alias("key"), key.alias("word"), source.alias("source"), F.floor(F.col("l_quantity") / 10).cast("double").alias("score"))
    nobody = spark.createDataFrame([], "key string, senses long")
    return screen.rank_synonyms(rows, nobody, 6).select("synset", "key", F.col("place").cast("long").alias("place"))


@register()
def serving_picker(spark, sf_dir):
    """The tiny lexicon's sentences; their scores are tested (tests/test_library.py), ``picker_sentences`` has the SQL."""
    tables, asked = serving.fixture(spark)
    return picker.pick(asked, tables, serving.LISTS).filter("place = 1").select("qid", "synset", "score")
