"""Tokens and embeddings."""

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, StructField, StructType

from postloom.functions.text import words
from postloom.operators.bounded import dense_index
from postloom.operators.lineage import stored
from postloom.operators.profile import count_tokens

# Ids of the special tokens and the window of common encoders.
PAD, UNKNOWN, START, END = 0, 1, 2, 3
WINDOW = 512
BATCH_SIZE = 128
HASH_DIM = 64
MAX_VOCABULARY = 1_000_000
HOT_ROWS, MAX_HOT = 100_000, 100_000  # places that make a token hot, and hot tokens that every task holds
CHUNK_CHARS = 1 << 24  # characters of the texts that share one lookup of their joined tokens
ELSEWHERE = -1  # stands for the id of a token that is not hot


def learn_vocabulary(df: DataFrame, text: str = "text", min_freq: int = 1) -> DataFrame:
    """(token, token_id): every token with at least ``min_freq`` occurrences."""
    counts = count_tokens(df, text, words, min_freq).select("token")
    return dense_index(counts, "token", "token_id", END + 1).withColumn("token_id", F.col("token_id").cast("int"))


def tokenize(
    df: DataFrame,
    vocabulary: DataFrame,
    text: str = "text",
    key: str = "id",
    max_length: int | None = None,
    max_vocabulary: int = MAX_VOCABULARY,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``input_ids`` (start, tokens, end) and ``attention_mask``.

    Every token is kept unless ``max_length`` (which counts the two special tokens) cuts; for
    models with a fixed window see ``token_windows``, which loses nothing.  A vocabulary
    within the bound goes to every task and each batch is looked up as a whole, without a
    shuffle.  Of a larger one, tokens with more than ``hot_rows`` places are looked up in this way; the others
    are joined by token, each once per chunk of rows, so that no token is a hot key, and put back per chunk.
    """
    token = words(F.col(text))
    if max_length is not None:
        token = F.slice(token, 1, max_length - 2)
    vocabulary = stored(vocabulary.select("token", "token_id"))  # learned once, however often it is read
    if vocabulary.count() > max_vocabulary:
        ids = _joined_ids(df, vocabulary, token, text, key, hot_rows)
    else:
        ids = df.withColumn("_ids", _looked_up(df.sparkSession, vocabulary.toArrow())(token))
    ids = ids.withColumn(
        "input_ids",
        F.when(F.col(text).isNotNull(), F.concat(F.array(F.lit(START)), "_ids", F.array(F.lit(END)))),
    )
    return ids.withColumn(
        "attention_mask", F.transform("input_ids", lambda _: F.lit(1))
    ).drop("_ids")


def _ids_of(tokens: pa.Array, known: pa.Array, ids: pa.Array, missing: int) -> np.ndarray:
    """The id of every token; only the distinct ones are looked up."""
    coded = tokens.dictionary_encode()
    distinct = pc.fill_null(ids.take(pc.index_in(coded.dictionary, value_set=known)), missing)
    return distinct.to_numpy(zero_copy_only=False).astype(np.int32)[coded.indices.to_numpy(zero_copy_only=False)]


def _lists(like: pa.Array, ids: np.ndarray) -> pa.Array:
    """The ids in lists as long as those of ``like``; null ones are empty."""
    sizes = pc.fill_null(pc.list_value_length(like), 0).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(ids, pa.int32()))


def _whole(column: pa.ChunkedArray) -> pa.Array:
    joined = column.combine_chunks()
    return joined if isinstance(joined, pa.Array) else joined.chunk(0)


def _shared(spark, vocabulary: pa.Table):
    return spark.sparkContext.broadcast((_whole(vocabulary["token"]), _whole(vocabulary["token_id"])))


def _looked_up(spark, vocabulary: pa.Table):
    shared = _shared(spark, vocabulary)

    @F.arrow_udf(ArrayType(IntegerType()))
    def lookup(tokens: pa.Array) -> pa.Array:
        return _lists(tokens, _ids_of(tokens.flatten(), *shared.value, UNKNOWN))

    return lookup


def _hot_tokens(df: DataFrame, vocabulary: DataFrame, token: Column, hot_rows: int) -> pa.Table:
    """(token, token_id) of tokens with more than ``hot_rows`` places.

    Tokens are counted with partial sums.  Should more of them be hot than every task can hold, the most
    frequent are looked up and the others joined: the bound decides how an id is found, not which.
    """
    counts = df.select(F.explode(token).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.where(F.col("_n") > hot_rows).orderBy(F.desc("_n"), "token").limit(MAX_HOT).select("token")
    ids = hot.join(vocabulary.select("token", "token_id"), "token", "left")
    return ids.select("token", F.coalesce("token_id", F.lit(UNKNOWN)).alias("token_id")).toArrow()


def _split_places(
    df: DataFrame, vocabulary: DataFrame, token: Column, key: str, hot_rows: int, head: pa.Table | None = None
) -> tuple[pa.Table, DataFrame]:
    """The hot tokens with their ids, and (key, token) of all places of the others."""
    head = _hot_tokens(df, vocabulary, token, hot_rows) if head is None else head
    hot = F.broadcast(df.sparkSession.createDataFrame(head.select(["token"]), "token string"))  # MAX_HOT rows at most
    return head, df.select(key, F.explode(token).alias("token")).join(hot, "token", "left_anti").select(key, "token")


def _joined_ids(df: DataFrame, vocabulary: DataFrame, token: Column, text: str, key: str, hot_rows: int) -> DataFrame:
    """Add ``_ids``: hot tokens by lookup in the row, all others by a join.

    Rows are dealt by hash to chunks of about CHUNK_CHARS characters.  A token moves once per chunk, not once
    per place, and comes back to the chunk with its id.
    """
    chars = df.agg(F.sum(F.length(text))).first()[0] or 0
    chunks = max(df.sparkSession.sparkContext.defaultParallelism, -(-chars // CHUNK_CHARS))
    chunked = df.withColumn("_chunk", F.pmod(F.xxhash64(key, text), F.lit(chunks)).cast("int")).repartition(chunks, "_chunk")
    head, rare = _split_places(chunked, vocabulary, token, "_chunk", hot_rows, _hot_tokens(df, vocabulary, token, hot_rows))
    found = rare.distinct().join(vocabulary, "token").select(F.col("_chunk").alias("_at"), "token", "token_id")
    found = found.repartition(chunks, "_at")  # as the rows are, which therefore do not move again
    shared = _shared(df.sparkSession, head)
    schema = StructType([*df.schema.fields, StructField("_ids", ArrayType(IntegerType()))])

    def fill(rows: pa.Table, pieces: pa.Table) -> pa.Table:
        lists = _whole(rows["_tokens"])
        tokens = lists.flatten()
        ids = _ids_of(tokens, *shared.value, ELSEWHERE)
        rest = ids == ELSEWHERE
        ids[rest] = _ids_of(tokens.filter(pa.array(rest)), _whole(pieces["token"]), _whole(pieces["token_id"]), UNKNOWN)
        return rows.drop_columns(["_chunk", "_tokens"]).append_column("_ids", _lists(lists, ids))

    return chunked.withColumn("_tokens", token).groupBy("_chunk").cogroup(found.groupBy("_at")).applyInArrow(fill, schema)


def hashed_vector(tokens: Column, dim: int = HASH_DIM) -> Column:
    """Unit-length signed bag of words: the MD5 of a token gives its component and sign.

    Each distinct token of a batch is hashed once; a batch is one weighted count.
    """
    @F.arrow_udf(ArrayType(DoubleType()))
    def embed(lists: pa.Array) -> pa.Array:
        coded = lists.flatten().dictionary_encode()
        digests = [hashlib.md5(t.encode()).hexdigest() for t in coded.dictionary.to_pylist()]
        component = np.array([int(d[:8], 16) % dim for d in digests], dtype=np.int64)
        sign = np.array([1.0 if d[8] < "8" else -1.0 for d in digests])
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(lists)), sizes)
        code = coded.indices.to_numpy(zero_copy_only=False)
        cells = row * dim + component[code] if len(code) else np.zeros(0, np.int64)
        weight = sign[code] if len(code) else np.zeros(0)
        dense = np.bincount(cells, weights=weight, minlength=len(lists) * dim).astype(np.float64).reshape(-1, dim)
        norm = np.sqrt(np.einsum("ij,ij->i", dense, dense))
        dense /= np.where(norm > 0, norm, 1.0)[:, None]
        offsets = np.arange(0, dense.size + 1, dim, dtype=np.int32)
        return pa.ListArray.from_arrays(offsets, pa.array(dense.ravel()), mask=pc.is_null(lists))

    return embed(tokens)


def embed_text(
    df: DataFrame,
    text: str = "text",
    make_predict_fn: Callable | None = None,
    batch_size: int = BATCH_SIZE,
    dim: int = HASH_DIM,
    name: str = "embedding",
) -> DataFrame:
    """Add one vector per row.

    ``make_predict_fn`` loads a model once per Python worker and returns a function from an
    array of texts to a matrix (see ``predict_batch_udf``).  Without a model the vector is
    a hashed bag of words.
    """
    if make_predict_fn is None:
        return df.withColumn(name, hashed_vector(words(F.col(text)), dim))
    model = predict_batch_udf(make_predict_fn, return_type=ArrayType(FloatType()), batch_size=batch_size)
    return df.withColumn(name, model(F.col(text)))


def token_windows(df: DataFrame, size: int = WINDOW, stride: int | None = None) -> DataFrame:
    """One row per window of ``size`` ids, numbered by ``window`` from 0; no token is lost.

    A window is start, up to ``size - 2`` tokens, end; windows begin every ``stride`` tokens
    (default: end to end, without overlap).  A text without tokens has one empty window; rows
    without ids keep null ids in window 0.
    """
    room = size - 2
    step = room if stride is None else stride
    if room < 1 or not 1 <= step <= room:
        raise ValueError("a window holds at least one token, and windows leave no gap")
    inner = F.slice("input_ids", F.lit(2), F.greatest(F.size("input_ids") - 2, F.lit(0)))
    count = F.greatest(F.ceil((F.size("_inner") - room) / step), F.lit(0)).cast("int")
    rows = df.withColumn("_inner", inner).withColumn(
        "window", F.explode(F.when(F.col("input_ids").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), count)))
    )
    part = F.slice("_inner", F.col("window") * step + 1, F.lit(room))
    return rows.withColumn(
        "input_ids", F.when(F.col("input_ids").isNotNull(), F.concat(F.array(F.lit(START)), part, F.array(F.lit(END))))
    ).withColumn("attention_mask", F.transform("input_ids", lambda _: F.lit(1))).drop("_inner")


def _padded(lists: pa.Array, fill: int, width: int | None = None) -> np.ndarray:
    """The lists as rows of a matrix, as wide as the longest unless told."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.full((len(lists), int(sizes.max(initial=0)) if width is None else width), fill, np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def embed_tokens(
    df: DataFrame, make_predict_fn: Callable, batch_size: int = BATCH_SIZE, name: str = "embedding"
) -> DataFrame:
    """Add one vector per row from ``input_ids`` and ``attention_mask``.

    ``make_predict_fn`` loads a model once per Python worker and returns a function from two
    int matrices (ids and mask, padded with PAD and 0 to the longest row of the batch) to a
    matrix with one row per input row.  Rows without ids get a null vector.
    """
    @F.arrow_udf(ArrayType(DoubleType()))
    def embed(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        predict = make_predict_fn()
        for ids, mask in batches:
            known = np.flatnonzero(np.asarray(ids.is_valid()))
            out: list = [None] * len(ids)
            for start in range(0, len(known), batch_size):
                rows = known[start:start + batch_size]
                padded = _padded(ids.take(pa.array(rows)), PAD)
                seen = _padded(mask.take(pa.array(rows)), 0, padded.shape[1])
                for i, vector in zip(rows, np.asarray(predict(padded, seen), np.float64), strict=True):
                    out[i] = vector.tolist()
            yield pa.array(out, pa.list_(pa.float64()))

    return df.withColumn(name, embed("input_ids", "attention_mask"))


def mean_of_windows(df: DataFrame, key: str, vec: str = "embedding") -> DataFrame:
    """(key, vec): the mean of a text's window vectors, each weighted by its tokens."""
    weight = F.greatest(F.size("input_ids") - 2, F.lit(1)).cast("double")
    cells = df.where(F.col(vec).isNotNull()).select(key, weight.alias("_w"), F.posexplode(vec).alias("_pos", "_x"))
    sums = cells.groupBy(key, "_pos").agg((F.sum(F.col("_x") * F.col("_w")) / F.sum("_w")).alias("_x"))
    return sums.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_pos", "_x"))).alias("_v")).select(
        key, F.col("_v._x").alias(vec)
    )
