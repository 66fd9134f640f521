"""The registered queries of the vocabulary and embedding operators, and their SQL.

A query's SQL is the same computation in DuckDB's dialect over the same tables; stochastic or order-bound operators have none.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import context, sampling, sgns, similarity, sketch, vocab
from ..sources import models, text
from ..sources.tables import table, workspace, written

V, SMALL = vocab.VOCABULARY, 1000
QUERIES: dict = {}
SQL: dict[str, str] = {}

TOK = r"""
lin as (
  select doc_id, source, line_no, n, list_filter(regexp_split_to_array(ls[line_no], '[ \t]+'), lambda x: x <> '') ws from (
    select doc_id, source, ls, len(ls) n, unnest(range(1, len(ls) + 1)) line_no from (
      select doc_id, source, string_split(replace(text, chr(13), ''), chr(10)) ls from documents where text is not null))),
tok as (select doc_id, source, line_no, pos, ws[pos] word from (select *, unnest(range(1, len(ws) + 1)) pos from lin))"""
CNT = TOK + ",\ncnt as (select word, count(*) count from tok group by word)"


def VOC(n: int) -> str:
    return CNT + f",\nvoc as (select word_id, word, count from (select *, row_number() over (order by count desc, word) - 1 word_id from cnt) where word_id < {n})"


def U(*key: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(key)})), 1, 8))::UBIGINT / 4294967296.0)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _tokens(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return text.tokens(_docs(spark, d), ["doc_id", *more])


def _vocab(spark: SparkSession, d: str, n: int = V) -> DataFrame:
    return vocab.exact_lm(_tokens(spark, d), n)


# Text


@query(f"with {TOK} select doc_id, line_no, pos, word from tok")
def tokens_by_line(spark, d):
    return _tokens(spark, d)


@query(f"with {TOK} select doc_id, line_no, cast(len(ws) as bigint) n_tokens from lin where not (line_no = n and len(ws) = 0)")
def sentence_lengths(spark, d):
    return text.lines(_docs(spark, d), ["doc_id"]).select("doc_id", "line_no", F.size("ws").cast("long").alias("n_tokens"))


@query(f"with {TOK} select doc_id, line_no, (pos - 1) // 20 chunk, count(*) n_tokens from tok group by all")
def sentence_chunking(spark, d):
    x = text.sentences(_docs(spark, d), ["doc_id"], limit=20)
    return x.where(F.size("ws") > 0).select("doc_id", "line_no", "chunk", F.size("ws").cast("long").alias("n_tokens"))


# Vocabulary


@query(f"with {CNT} select word, count from cnt")
def vocab_counts(spark, d):
    return vocab.counts(_tokens(spark, d))


@query(f"""with {TOK}, f as (select word, count(*) count, min(doc_id * 1000000000000 + line_no * 1000000 + pos) k from tok group by word)
select row_number() over (order by k) - 1 word_id, word, count from f""")
def vocab_first_seen_ids(spark, d):
    return vocab.first_seen(_tokens(spark, d), "doc_id", "line_no", "pos")


@query(f"with {VOC(V)} select word_id, word, count from voc")
def vocab_topk_ids(spark, d):
    return _vocab(spark, d)


@query(f"with {CNT} select row_number() over (order by count desc, word) - 1 word_id, word, count from cnt")
def vocab_sorted_ids(spark, d):
    return vocab.sort(vocab.counts(_tokens(spark, d)))


@query(f"with {VOC(V)} select count(*) size, cast(sum(count) as bigint) total, cast({V} as bigint) capacity from voc")
def lm_summary(spark, d):
    return vocab.summary(_vocab(spark, d), V)


@query(f"with {CNT} select row_number() over (order by count desc, word) - 1 rank, count from cnt")
def ordered_counts(spark, d):
    return vocab.ordered_counts(vocab.counts(_tokens(spark, d)))


@query(f"with {VOC(V)} select word_id, word || ' ' || count line from voc")
def vocab_text_lines(spark, d):
    return text.vocab_lines(_vocab(spark, d))


@query("select lang word, cast(sum(n_chars) as bigint) count, row_number() over (order by sum(n_chars) desc, lang) - 1 word_id from documents group by lang")
def vocab_from_counts(spark, d):
    return vocab.from_counts(_docs(spark, d).select(F.col("lang").alias("word"), F.col("n_chars").alias("count")))


CONV = r"""
ctok as (select conv_id, turn, line_no, pos, ws[pos] word from (select *, unnest(range(1, len(ws) + 1)) pos from (
  select conv_id, turn, line_no, list_filter(regexp_split_to_array(ls[line_no], '[ \t]+'), lambda x: x <> '') ws from (
    select conv_id, turn, ls, unnest(range(1, len(ls) + 1)) line_no from (
      select conv_id, turn, string_split(replace(text, chr(13), ''), chr(10)) ls from conversations where text is not null)))))"""


@query(f"with {VOC(V)}, {CONV} select conv_id, turn, line_no, pos, ctok.word, coalesce(word_id, -1) word_id from ctok left join voc on ctok.word = voc.word")
def lookup_ids_with_oov(spark, d):
    x = text.tokens(table(spark, d, "conversations"), ["conv_id", "turn"])
    return vocab.lookup(x, _vocab(spark, d)).select("conv_id", "turn", "line_no", "pos", "word", "word_id")


def OOV_RATE(n: int) -> str:
    return f"with {VOC(n)} select source, count(*) n_tokens, count(*) - count(word_id) n_oov from tok left join voc on tok.word = voc.word group by source"


def _oov_rate(spark, d, n: int) -> DataFrame:
    x = vocab.lookup(_tokens(spark, d, "source"), _vocab(spark, d, n), n)
    return x.groupBy("source").agg(F.count("*").alias("n_tokens"), F.sum((F.col("word_id") < 0).cast("long")).alias("n_oov"))


@query(OOV_RATE(SMALL))
def oov_rate_by_source(spark, d):
    return _oov_rate(spark, d, SMALL)


@query(OOV_RATE(V))
def oov_rate_by_source_full(spark, d):
    return _oov_rate(spark, d, V)


def ENC(n: int) -> str:
    return VOC(n) + ",\nenc as (select doc_id, line_no, list(word_id order by pos) ids from tok join voc on tok.word = voc.word group by doc_id, line_no)"


def _encoded(spark, d, n: int = V) -> DataFrame:
    return vocab.encode_in_place(text.lines(_docs(spark, d), ["doc_id"]), _vocab(spark, d, n), ["doc_id", "line_no"])


def ENC_TEXT(n: int) -> str:
    return f"with {ENC(n)} select doc_id, line_no, cast(len(ids) as bigint) n_ids, array_to_string(ids, ' ') ids_text from enc"


def _encoded_text(spark, d, n: int) -> DataFrame:
    return _encoded(spark, d, n).select("doc_id", "line_no", F.size("ids").cast("long").alias("n_ids"), F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids_text"))


@query(ENC_TEXT(SMALL))
def encoded_sentences(spark, d):
    return _encoded_text(spark, d, SMALL)


@query(ENC_TEXT(V))
def encoded_sentences_full(spark, d):
    return _encoded_text(spark, d, V)


@query(f"with {VOC(SMALL)}, ids as (select unnest(range(0, 2000, 7)) word_id) select word_id, word, count from ids join voc using (word_id)")
def reverse_lookup(spark, d):
    return vocab.reverse_lookup(spark.range(0, 2000, 7).withColumnRenamed("id", "word_id"), _vocab(spark, d, SMALL)).select("word_id", "word", "count")


#: All ids of the vocabulary, and a thousand unknown ones.
ASKED = V + 1000


@query(f"with {VOC(V)}, ids as (select unnest(range(0, {ASKED})) word_id) select word_id, word, count from ids join voc using (word_id)")
def reverse_lookup_full(spark, d):
    return vocab.reverse_lookup(spark.range(ASKED).withColumnRenamed("id", "word_id"), _vocab(spark, d)).select("word_id", "word", "count")


def HAS_OOV(n: int) -> str:
    return f"""with {VOC(n)}, x as (select doc_id, line_no, pos, coalesce(word_id, -1) i from tok left join voc on tok.word = voc.word),
w as (select doc_id, min(i) over (partition by doc_id, line_no order by pos rows between current row and 3 following) m, count(*) over (partition by doc_id, line_no order by pos rows between current row and 3 following) c from x)
select doc_id, count(*) n_windows, count(*) filter (where m < 0) n_with_oov from w where c = 4 group by doc_id"""


def _has_oov(spark, d, n: int) -> DataFrame:
    x = vocab.lookup(_tokens(spark, d), _vocab(spark, d, n), n)
    x = vocab.encode_sentences(x, ["doc_id", "line_no"]).where(F.size("ids") >= 4)
    at = F.sequence(F.lit(1), F.size("ids") - 3)
    x = x.select("doc_id", "ids", F.explode(at).alias("at")).select("doc_id", context.has_oov(F.slice("ids", F.col("at"), 4)).alias("oov"))
    return x.groupBy("doc_id").agg(F.count("*").alias("n_windows"), F.sum(F.col("oov").cast("long")).alias("n_with_oov"))


@query(HAS_OOV(SMALL))
def context_has_oov(spark, d):
    return _has_oov(spark, d, SMALL)


@query(HAS_OOV(V))
def context_has_oov_full(spark, d):
    return _has_oov(spark, d, V)


@query(f"with {VOC(V)}, t as (select sum(count) total from voc) select word_id, word, round(least(1.0, sqrt(0.001 * total / count)), 9) keep_prob from voc, t")
def keep_probability(spark, d):
    v = _vocab(spark, d)
    total = v.agg(F.sum("count").alias("total"))
    return v.crossJoin(F.broadcast(total)).select("word_id", "word", F.round(vocab.keep_probability(F.col("count"), F.col("total")), 9).alias("keep_prob"))


@query(f"""with {VOC(V)}, t as (select sum(count) total from voc)
select doc_id, line_no, pos, tok.word, word_id from tok join voc on tok.word = voc.word, t where {U("'s'", 'doc_id', 'line_no', 'pos')} > 1 - sqrt(0.001 * total / count)""")
def subsampled_tokens(spark, d):
    v = _vocab(spark, d)
    total = v.agg(F.sum("count")).first()[0] or 0
    return vocab.subsample(_tokens(spark, d), v, total, ["doc_id", "line_no", "pos"]).select("doc_id", "line_no", "pos", "word", "word_id")


# Noise


@query(f"with {VOC(V)} select word_id, round(pow(count, 0.75) / sum(pow(count, 0.75)) over (), 9) p from voc")
def noise_distribution(spark, d):
    return sampling.normalize(_vocab(spark, d), digits=9).select("word_id", "p")


NOISE = """
grp as (select row_number() over (order by lang, source) - 1 id, lang, source, count(*) count from documents group by lang, source),
noise as (select id, round(pow(count, 0.75) / sum(pow(count, 0.75)) over (), 9) p from grp),
z as (select id, p, floor(1000 * sum(p) over (order by id)) + 1 - id z from noise),
e as (select id, p, cast(case when id = max(id) over () then 1000 else least(1000, id + max(z) over (order by id)) end as bigint) "end" from z),
s as (select id, p, cast(lag("end", 1, 0) over (order by id) as bigint) "start", "end" from e)"""


def _noise(spark, d) -> DataFrame:
    from pyspark.sql.window import Window

    groups = _docs(spark, d).groupBy("lang", "source").agg(F.count("*").alias("count"))  # languages times sources: few
    x = groups.withColumn("id", (F.row_number().over(Window.orderBy("lang", "source")) - 1).cast("long"))
    return sampling.normalize(x, "id", digits=9).select("id", "p")


@query(f'with {NOISE} select id, p, "start", "end" from s')
def noise_slots(spark, d):
    return sampling.slots(_noise(spark, d), 1000).select("id", "p", "start", "end")


DRAWS = "d as (select unnest(range(0, 5000)) draw)"


@query(f"""with {NOISE}, {DRAWS}, u as (select draw, {U("'c'", 'draw')} u from d), c as (select id, sum(p) over (order by id) high from noise)
select draw, coalesce((select min(id) from c where c.high >= u.u), (select max(id) from c)) id from u""")
def cumulative_sampler_draws(spark, d):
    draws = spark.range(5000).select(F.col("id").alias("draw")).withColumn("u", N.uniform("c", F.col("draw")))
    return sampling.draw_cumulative(_noise(spark, d), draws, "id").select("draw", "id")


@query(f"""with {NOISE}, {DRAWS}, u as (select draw, floor({U("'k'", 'draw')} * 1000) slot from d) select draw, id from u join s on slot >= "start" and slot < "end" """)
def discrete_draws(spark, d):
    draws = spark.range(5000).select(F.col("id").alias("draw")).withColumn("u", N.uniform("k", F.col("draw")))
    return sampling.draw_slots(sampling.slots(_noise(spark, d), 1000), draws, 1000).select("draw", "id")


@query(f"with {DRAWS}, n as (select count(distinct source) n from documents) select draw, cast(floor({U(chr(39) + 'u' + chr(39), 'draw')} * n) as bigint) id from d, n")
def uniform_draws(spark, d):
    n = _docs(spark, d).agg(F.countDistinct("source")).first()[0]
    return spark.range(5000).select(F.col("id").alias("draw")).withColumn("id", sampling.uniform_id(n, "u", F.col("draw")))


@query("select event_id, user_id, event_type from events order by md5('r:' || event_id), event_id limit 50")
def reservoir_bottomk(spark, d):
    return sampling.reservoir(table(spark, d, "events"), 50, "event_id").select("event_id", "user_id", "event_type")


@query(f"with {NOISE} select id, round(p / sum(p) over (), 7) p from noise")
def alias_table_distribution(spark, d):
    rows = sorted(tuple(r) for r in _noise(spark, d).collect())
    p = np.array([x for _, x in rows])
    implied = sampling.alias_implied(*sampling.alias_table(p / p.sum()))
    return spark.createDataFrame([(int(i), float(x)) for (i, _), x in zip(rows, implied, strict=True)], "id long, p double").withColumn("p", F.round("p", 7))


RAND = "r as (select draw, unnest(range(0, 8)) i from d)"


@query(f"""with {DRAWS}, {RAND} select draw, cast(i as bigint) i, round({U("'v'", 'draw', 'i')} - 0.5, 9) x from r""")
def centered_uniform_vectors(spark, d):
    x = spark.range(5000).select(F.col("id").alias("draw"), F.posexplode(sampling.centered_uniform_vector(8, "v", F.col("id"))).alias("i", "x"))
    return x.select("draw", F.col("i").cast("long").alias("i"), F.round("x", 9).alias("x"))


@query(f"""with {DRAWS}, {RAND} select draw, cast(i as bigint) i, round(sqrt(-2 * ln(1 - {U("'g'", 'draw', "'a'", 'i')})) * cos(2 * pi() * {U("'g'", 'draw', "'b'", 'i')}), 7) x from r""")
def gaussian_vectors(spark, d):
    x = spark.range(5000).select(F.col("id").alias("draw"), F.posexplode(sampling.gaussian_vector(8, "g", F.col("id"))).alias("i", "x"))
    return x.select("draw", F.col("i").cast("long").alias("i"), F.round("x", 7).alias("x"))


# Contexts


def PAIR(n: int, reach: str) -> str:
    return ENC(n) + f",\nx as (select doc_id, line_no, ids, pos, ids[pos] target, {reach} r from (select *, unnest(range(1, len(ids) + 1)) pos from enc)),\n" + (
        "p as (select doc_id, line_no, pos, target, ids[q] context from (select *, unnest(range(greatest(1, pos - r), least(len(ids), pos + r) + 1)) q from x) where q <> pos)"
    )


DYNAMIC = "1 + cast(floor(" + U("'w'", "doc_id", "line_no", "pos") + " * 5) as bigint)"


def PAIR_COUNTS(n: int, reach: str, more: str = "") -> str:
    return f"with {PAIR(n, reach)} select target, context, count(*) n from p group by all{more}"


def _pair_counts(spark, d, n: int, c: int, dynamic: str | None = None) -> DataFrame:
    x = context.pairs(_encoded(spark, d, n), ["doc_id", "line_no"], c=c, dynamic=dynamic)
    # One number for a pair, as ids are below 2^31: half the key to hash, compare and shuffle.
    x = x.select((F.shiftleft("target", 32) + F.col("context")).alias("_pair")).groupBy("_pair").agg(F.count("*").alias("n"))
    return x.select(F.shiftright("_pair", 32).alias("target"), F.col("_pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("context"), "n")


@query(PAIR_COUNTS(SMALL, "2"))
def skipgram_pairs_static(spark, d):
    return _pair_counts(spark, d, SMALL, 2)


@query(PAIR_COUNTS(V, "2"))
def skipgram_pairs_static_full(spark, d):
    return _pair_counts(spark, d, V, 2)


@query(PAIR_COUNTS(SMALL, DYNAMIC))
def skipgram_pairs_dynamic(spark, d):
    return _pair_counts(spark, d, SMALL, 5, "w")


@query(PAIR_COUNTS(V, DYNAMIC))
def skipgram_pairs_dynamic_full(spark, d):
    return _pair_counts(spark, d, V, 5, "w")


MOST = " order by n desc, target, context limit 100"


@query(PAIR_COUNTS(SMALL, "5", MOST))
def pair_counts_topk(spark, d):
    return _pair_counts(spark, d, SMALL, 5).orderBy(F.desc("n"), "target", "context").limit(100)


@query(PAIR_COUNTS(V, "5", MOST))
def pair_counts_topk_full(spark, d):
    return _pair_counts(spark, d, V, 5).orderBy(F.desc("n"), "target", "context").limit(100)


# Functions


ELEM = "el as (select vec_id, i, cast(embedding[i] as double) * 60 x from (select *, unnest(range(1, len(embedding) + 1)) i from embeddings))"


def _elements(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("_i", "_x")).select("vec_id", (F.col("_i") + 1).cast("long").alias("i"), (F.col("_x").cast("double") * 60).alias("x"))


@query(f"with {ELEM} select vec_id, i, round(case when x > 11 then 1.0 when x < -11 then 0.0 else 1 / (1 + exp(-x)) end, 9) y from el")
def sigmoid_grid(spark, d):
    return _elements(spark, d).select("vec_id", "i", F.round(N.sigmoid("x"), 9).alias("y"))


def FAST(x: str) -> str:
    i = f"trunc(999 * (({x}) / 11.0 + 1) / 2)::bigint"
    return f"case when {i} < 0 then 0.0 when {i} >= 1000 then 1.0 else 1 / (1 + exp(-(11.0 * ({i} / 999.0 - 0.5) * 2))) end"


@query(f"with {ELEM} select vec_id, i, round({FAST('x')}, 9) y from el")
def fast_sigmoid_grid(spark, d):
    return _elements(spark, d).select("vec_id", "i", F.round(N.fast_sigmoid("x"), 9).alias("y"))


def _vectors(spark, d):
    return table(spark, d, "embeddings")


def _next(spark, d):
    """Each vector beside the one with the next id."""
    e = _vectors(spark, d)
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")


NEXT = "nx as (select a.vec_id, cast(a.embedding as double[]) a, cast(b.embedding as double[]) b from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)"


@query("select vec_id, round(sqrt(list_sum(list_transform(cast(embedding as double[]), lambda x: x * x))), 6) norm from embeddings")
def vec_norms(spark, d):
    return _vectors(spark, d).select("vec_id", F.round(N.norm("embedding"), 6).alias("norm"))


@query(f"with {NEXT} select vec_id, round(list_dot_product(a, b), 6) dot from nx")
def vec_dot(spark, d):
    return _next(spark, d).select("vec_id", F.round(N.dot("embedding", "other"), 6).alias("dot"))


@query(f"with {NEXT} select vec_id, i, round(b[i] + 7 * a[i], 6) y from (select *, unnest(range(1, len(a) + 1)) i from nx)")
def vec_axpy(spark, d):
    return _next(spark, d).select("vec_id", F.posexplode(N.axpy(7.0, "embedding", "other")).alias("_i", "y")).select("vec_id", (F.col("_i") + 1).cast("long").alias("i"), F.round("y", 6).alias("y"))


@query("select vec_id, i, round(cast(embedding[i] as double) * 7, 6) y from (select *, unnest(range(1, len(embedding) + 1)) i from embeddings)")
def vec_scale(spark, d):
    return _vectors(spark, d).select("vec_id", F.posexplode(N.scal(7.0, "embedding")).alias("_i", "y")).select("vec_id", (F.col("_i") + 1).cast("long").alias("i"), F.round("y", 6).alias("y"))


@query(f"with {NEXT} select vec_id, list_bool_and(list_transform(range(1, len(a) + 1), lambda i: abs(a[i] - b[i]) < 0.3)) near from nx")
def vec_near(spark, d):
    return _next(spark, d).select("vec_id", N.near_vectors("embedding", "other", 0.3).alias("near"))


@query("""with n as (select vec_id, embedding, sqrt(list_sum(list_transform(cast(embedding as double[]), lambda x: x * x))) s from embeddings)
select vec_id, i, round(cast(embedding[i] as double) / s, 6) y from (select *, unnest(range(1, len(embedding) + 1)) i from n)""")
def l2_normalized(spark, d):
    return _vectors(spark, d).select("vec_id", F.posexplode(N.unit("embedding")).alias("_i", "y")).select("vec_id", (F.col("_i") + 1).cast("long").alias("i"), F.round("y", 6).alias("y"))


# Similarity and training arithmetic


@query("""select a.vec_id a, b.vec_id b, round(list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])), 6) similarity
from embeddings a join embeddings b on b.vec_id between a.vec_id + 1 and a.vec_id + 5""")
def cosine_pairs(spark, d):
    e = _vectors(spark, d)
    pairs = e.select(F.col("vec_id").alias("a"), F.explode(F.sequence(F.col("vec_id") + 1, F.col("vec_id") + 5)).alias("b"))
    return similarity.pair_similarity(pairs, e, "vec_id", "embedding").select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("""with e as (select vec_id, cast(embedding as double[]) v from embeddings),
s as (select a.vec_id query_id, b.vec_id neighbor_id, list_cosine_similarity(a.v, b.v) s from e a, e b where a.vec_id <> b.vec_id)
select query_id, neighbor_id, round(s, 6) similarity from (select *, row_number() over (partition by query_id order by s desc, neighbor_id) r from s) where r = 1""")
def nearest_neighbor(spark, d):
    x = similarity.nearest_neighbor(_vectors(spark, d), key="vec_id", vector="embedding")
    return x.select("query_id", "neighbor_id", F.round("similarity", 6).alias("similarity"))


@query(f"""with e as (select vec_id, cast(embedding as double[]) v from embeddings),
c as (select vec_id context_id, unnest([vec_id - 1, vec_id + 1]) i from embeddings),
x as (select context_id, v from c join e on e.vec_id = c.i),
s as (select context_id, e.vec_id neighbor_id, sum({FAST('list_dot_product(e.v, x.v)')}) s from x, e group by all)
select context_id, neighbor_id, round(s, 6) score from (select *, row_number() over (partition by context_id order by round(s, 12) desc, neighbor_id) r from s) where r = 1""")
def context_nearest_neighbor(spark, d):
    e = _vectors(spark, d)
    model = e.select(F.col("vec_id").alias("word_id"), F.col("embedding").alias("word_vec"), F.col("embedding").alias("context_vec"))
    contexts = e.select(F.col("vec_id").alias("context_id"), F.array(F.col("vec_id") - 1, F.col("vec_id") + 1).alias("ids"))
    return similarity.context_nearest_neighbor(model, contexts).select("context_id", "neighbor_id", F.round("score", 6).alias("score"))


@query(f"with {NEXT} select vec_id, round(1 - {FAST('list_dot_product(a, b)')}, 6) positive, round(0 - {FAST('list_dot_product(a, b)')}, 6) negative from nx")
def gradient_coeff(spark, d):
    return _next(spark, d).select("vec_id", F.round(N.gradient_coefficient("embedding", "other"), 6).alias("positive"), F.round(N.gradient_coefficient("embedding", "other", True), 6).alias("negative"))


@query(f"with {VOC(V)}, t as (select sum(count) total from voc) select word_id, round(greatest(0.0000025, 0.025 * (1 - count / (total / 20))), 9) rate from voc, t")
def learning_rate_schedule(spark, d):
    v = _vocab(spark, d)
    total = v.agg(F.sum("count")).first()[0] or 0
    return v.select("word_id", F.round(N.learning_rate("count", total / 20, 0.025, 2.5e-6), 9).alias("rate"))


@query()
def embedding_text_lines(spark, d):
    return models.embedding_lines(_vectors(spark, d), "embedding", "vec_id")


# Sketches, training, streams


@query("select event_type word, count(*) count from events group by event_type")
def spacesaving_exact_regime(spark, d):
    return sketch.merged(table(spark, d, "events").select(F.col("event_type").alias("word")), 1000).select("word", "count")


@query()
def spacesaving_topk(spark, d):
    return sketch.exact_order(text.lines(_docs(spark, d), ["doc_id"]), V, "doc_id", "line_no")


@query()
def spacesaving_merged(spark, d):
    return sketch.merged(_tokens(spark, d), V)


@query()
def spacesaving_streaming(spark, d):
    from ..streaming import stateful as S

    x = text.lines(S.read_stream(spark, f"{d}/documents.parquet"), ["doc_id"])
    return S.run_to_end(S.sketch_stream(x, V, ["doc_id", "line_no"]), "sketch-stream").select("word_id", "word", "count", "total")


def _trained(spark, d, **settings):
    v = written(_vocab(spark, d), workspace(spark, "vocabulary"))  # counted once: encoding and training read it
    total = v.agg(F.sum("count")).first()[0] or 0
    key = ["doc_id", "line_no", "chunk"]
    sentences = vocab.encode_in_place(text.sentences(_docs(spark, d), ["doc_id"]), v, key, total, vocab.THRESHOLD)
    return sgns.train(sentences, v, order=tuple(key), **settings)


def CHUNKED(limit: int) -> str:
    return f"""with {VOC(V)} select doc_id, line_no, (pos - 1) // {limit} chunk, array_to_string(list(word_id order by pos), ' ') ids_text
from tok join voc on tok.word = voc.word group by all"""


@query(CHUNKED(text.SENTENCE_LIMIT))
def encoded_sentences_chunked(spark, d):
    """Encoded sentences as training reads them: at most 1,000 words each."""
    x = vocab.encode_in_place(text.sentences(_docs(spark, d), ["doc_id"]), _vocab(spark, d), ["doc_id", "line_no", "chunk"])
    return x.select("doc_id", "line_no", "chunk", F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids_text"))


@query()
def sgns_train(spark, d):
    return _trained(spark, d)


@query()
def sgns_train_alias(spark, d):
    return _trained(spark, d, noise="alias")


@query()
def sgns_stream(spark, d):
    from ..streaming import stateful as S

    x = text.sentences(S.read_stream(spark, f"{d}/conversations.parquet"), ["conv_id", "turn"])
    out = S.run_to_end(S.sgns_stream(x, V, ["conv_id", "turn", "line_no", "chunk"]), "sgns-stream")
    return out.select("word_id", "word", "count", "total", "word_vec")
