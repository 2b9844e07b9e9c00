"""What several operators share: the shared folder, Arrow slices, bounded word caches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

# Bytes of text a worker turns into numpy arrays at once; one longer text is handled alone.
SLICE_BYTES = 2 << 20
# Bytes a task and its worker hand each other at once: what Spark holds of them outside its heap grows with it.
BATCH_BYTES = 4 << 20
# Words a worker remembers; beyond that it forgets them all and starts again.
CACHED_WORDS = 600_000


def scratch(spark: SparkSession) -> str:
    """A fresh folder path that driver and executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if spark.sparkContext.master.split("[")[0] == "local":
            shared = tempfile.mkdtemp(prefix="varve-")
        else:
            shared = f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    return f"{shared}/varve-llm-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends, lost executors cost nothing."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, underlined until no column of ``df`` has it (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of ``batch`` whose texts add up to about ``limit`` bytes."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = held = 0
    for at, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a column, nulls as empty ones."""
    return [t or "" for t in batch.column(name).to_pylist()]


def strings(values: pa.Array) -> list[str]:
    """Many short strings: several times as fast as to_pylist()."""
    return values.to_numpy(zero_copy_only=False).tolist()


def give_back() -> None:
    """Return freed memory to the system: an idle worker's share is wanted by other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not this C library


# Fixed values of the C library: the parameter that says from which size on memory is mapped, and that size.
_MAPPED_FROM, _MAPPED = -3, 1 << 20


def return_large() -> None:
    """From now on this worker's large arrays, Arrow's too, go back to the system as soon as they are freed.

    Left alone, the C library raises that size to 32 MB, and what is freed below stays with the worker.
    """
    try:
        ctypes.CDLL(None).mallopt(_MAPPED_FROM, _MAPPED)
        pa.set_memory_pool(pa.system_memory_pool())
    except (AttributeError, OSError):
        pass  # not this C library


# Kind -> key, stage that used it last, value.
_KEPT: dict[str, tuple] = {}


def forget_others(kind: str | None = None) -> int:
    """Drop what tasks of other stages kept, but for ``kind``; the stage of this task."""
    context = TaskContext.get()
    stage = context.stageId() if context else -1
    old = [k for k, (_, last, _) in _KEPT.items() if k != kind and last != stage]
    for k in old:
        del _KEPT[k]
    if old:
        give_back()
    return stage


def kept(key: tuple, make: Callable):
    """``make()``, kept for the tasks of a Python worker that follow and ask for the same ``key``.

    Of a kind (the key's first part) only the last one is kept, and what the tasks of other stages
    kept goes when a stage asks for the first time: workers live longer than the operators.
    """
    stage = forget_others(key[0])
    if key[0] not in _KEPT or _KEPT[key[0]][0] != key:
        _KEPT.pop(key[0], None)
        _KEPT[key[0]] = (key, stage, make())
    value = _KEPT[key[0]][2]
    _KEPT[key[0]] = (key, stage, value)
    return value


def small_batches() -> None:
    """Arrow batches of this session hold about ``BATCH_BYTES`` from now on, unless it has a limit of its own."""
    spark = SparkSession.getActiveSession()
    if spark and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` as a task that starts without what other stages kept, gets small batches and leaves no freed memory with
    the worker."""
    small_batches()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return_large()
        forget_others()
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


class WordCache(dict):
    """Values of words, computed for all unknown words of a slice together.

    When it is full it keeps the words met since the last time, so frequent ones stay.
    """

    def __init__(self, compute: Callable[[list[str]], Iterable], most: int = CACHED_WORDS):
        super().__init__()
        self.compute, self.most, self.older = compute, most, {}

    def of(self, words: list[str]) -> list:
        """The value of each of ``words``."""
        out = list(map(self.get, words))
        missing = [k for k, value in enumerate(out) if value is None]
        if missing:
            wanted = {words[k] for k in missing}
            if 2 * (len(self) + len(wanted)) > self.most:
                # Words of this slice that are known move on with it.
                self.older = dict(self)
                self.clear()
                wanted = set(words)
            older = self.older.get
            known = {w: v for w in wanted if (v := older(w)) is not None}
            self.update(known)
            new = list(wanted.difference(known))
            self.update(zip(new, self.compute(new)))
            for k in missing:
                out[k] = self[words[k]]
        return out


def parts_of(flat: list, sizes: Iterable[int]) -> Iterator[list]:
    """Consecutive stretches of ``flat`` of the given sizes."""
    start = 0
    for size in sizes:
        yield flat[start : start + size]
        start += size
