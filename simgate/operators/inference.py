"""Model inference in partitions, in one pass: a picture is detected, cut and embedded with its bytes in hand.

``load`` runs once in each task and returns the model: a function of a list of bytes that returns a
list of vectors (embedders) or of lists of boxes (detectors), None for an input it can't decode.
Batches fill across Arrow batches, close by number or by bytes, and the last one is flushed; only one
batch of pictures is held as Python objects at a time. The content of pictures is never shuffled: what is
known of a picture goes through the pass with it.

Nothing is dropped: a row says ok, no_detection or corrupt. A picture is corrupt that the model gives
None for or raises for (no other of its batch is), that has a box without positive sides, or whose box cannot be
cut or embedded. Rows come in the order of their pictures, those of one picture the surest detection first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from simgate.functions.pictures import Header, box_in, header
from simgate.operators.guards import require

#: Pictures and bytes of a batch for a model, and rows and bytes of a batch that leaves a task.
BATCH, BATCH_BYTES = 32, 64_000_000
OUT_ROWS = 1_000
BOX = ("confidence", "x1", "y1", "x2", "y2", "area_fraction")
DETECTION = "confidence double, x1 int, y1 int, x2 int, y2 int, area_fraction double"
SIZE = "image_width int, image_height int"
Load = Callable[[], Callable[[list], list]]
Cut = Callable[[bytes, tuple], bytes]


def filled(items: Iterable, size: int, weigh: Callable[[object], int], most: int = BATCH_BYTES) -> Iterator[list]:
    """Consecutive batches in order: closed at ``size`` items that weigh something, or at ``most`` bytes; the last one is shorter.

    Items without weight need no model; they wait in their place, up to sixteen times ``size`` of them.
    """
    held, heavy, weight = [], 0, 0
    for item in items:
        held.append(item)
        own = weigh(item)
        heavy, weight = heavy + (own > 0), weight + own
        if heavy >= size or weight >= most or len(held) >= 16 * size:
            yield held
            held, heavy, weight = [], 0, 0
    if held:
        yield held


def guarded(model: Callable[[list], list], items: list) -> list:
    """The model's results; where it raises for a batch, for each item alone, None for those it raises for."""
    if not items:
        return []
    try:
        found = list(model(items))
        if len(found) != len(items):
            raise ValueError(f"the model gave {len(found)} results for {len(items)} inputs")
        return found
    except Exception:
        if len(items) == 1:
            return [None]
        return [guarded(model, [x])[0] for x in items]


@dataclass
class Picture:
    """What one row of pictures carries through the pass."""

    carried: tuple
    raw: bytes
    head: Header | None = None
    status: str = "ok"
    boxes: list[dict] = field(default_factory=list)
    crops: list[bytes] = field(default_factory=list)
    vectors: list = field(default_factory=list)

    @property
    def size(self) -> tuple[int, int] | None:
        return self.head.upright() if self.head else None

    def spoil(self) -> None:
        self.status, self.boxes, self.crops, self.vectors = "corrupt", [], [], []


def _read(batches: Iterable[pa.RecordBatch], content: int) -> Iterator[Picture]:
    """A picture at a time, so that of a batch only one is a Python object."""
    for batch in batches:
        rest = [c for i, c in enumerate(batch.columns) if i != content]
        for k in range(batch.num_rows):
            raw = batch.column(content)[k].as_py() or b""
            yield Picture(tuple(c[k].as_py() for c in rest), raw, header(raw))


def _detected(pictures: Iterable[Picture], model: Callable[[list], list], least: float, batch: int) -> Iterator[Picture]:
    for held in filled(pictures, batch, lambda p: max(1, len(p.raw))):
        for p, boxes in zip(held, guarded(model, [p.raw for p in held]), strict=True):
            if boxes is None or any(b["x2"] <= b["x1"] or b["y2"] <= b["y1"] for b in boxes if b["confidence"] >= least):
                p.spoil()
            else:
                p.boxes = sorted((b for b in boxes if b["confidence"] >= least), key=lambda b: -b["confidence"])
                p.status = "ok" if p.boxes else "no_detection"
            yield p


def _cut(pictures: Iterable[Picture], cut: Cut, margin: float, top_only: bool) -> Iterator[Picture]:
    for p in pictures:
        p.boxes = p.boxes[:1] if top_only else p.boxes
        try:
            p.crops = [cut(p.raw, box_in((b["x1"], b["y1"], b["x2"], b["y2"]), margin, p.size)) for b in p.boxes]
        except Exception:
            p.spoil()
        p.raw = b""  # let go of what is no longer needed
        yield p


def _embedded(pictures: Iterable[Picture], model: Callable[[list], list], batch: int) -> Iterator[Picture]:
    for held in filled(pictures, batch, lambda p: sum(max(1, len(c)) for c in p.crops)):
        found = iter(guarded(model, [c for p in held for c in p.crops]))
        for p in held:
            p.vectors = [next(found) for _ in p.crops]
            if any(v is None for v in p.vectors):
                p.spoil()
            yield p


def _packed(pictures: Iterable[Picture], rows_of: Callable[[Picture], Iterator[tuple]], schema: pa.Schema, weigh: Callable[[Picture], int]) -> Iterator[pa.RecordBatch]:
    for held in filled(pictures, OUT_ROWS, weigh):
        columns = list(zip(*(row for p in held for row in rows_of(p)), strict=True))
        if columns:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _through(images: DataFrame, content: str, columns: str, steps: Callable[[Iterator[Picture]], Iterator[Picture]], own: Callable[[Picture], Iterator[tuple]], weigh: Callable[[Picture], int] = lambda p: 1) -> DataFrame:
    """One pass over images: all columns but the content, then those that ``own`` gives for each row of a picture."""
    rest = [c for c in images.columns if c != content]
    schema = StructType([*(images.schema[c] for c in rest), *StructType.fromDDL(columns)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _packed(steps(_read(batches, len(rest))), lambda p: ((*p.carried, *row) for row in own(p)), arrow, weigh)

    return images.select(*(F.col(f"`{c}`") for c in rest), F.col(f"`{content}`").cast("binary")).mapInArrow(run, schema)


def _size_of(p: Picture) -> tuple:
    return p.size or (None, None)


def with_size(images: DataFrame, content: str) -> DataFrame:
    """The rows without their content, with image_width and image_height as shown and the orientation; null where no header is known."""
    own = lambda p: iter([(*_size_of(p), p.head.orientation if p.head else None)])
    return _through(images, content, f"{SIZE}, orientation int", lambda pictures: pictures, own)


def embed(images: DataFrame, content: str, load: Load, batch: int = BATCH) -> DataFrame:
    """The rows without their content, with embedding and status: ok, or corrupt where there is none."""

    def steps(pictures: Iterator[Picture]) -> Iterator[Picture]:
        def whole() -> Iterator[Picture]:
            for p in pictures:
                p.crops, p.raw = [p.raw], b""
                yield p

        return _embedded(whole(), load(), batch)

    return _through(images, content, "embedding array<float>, status string", steps, lambda p: iter([(p.vectors[0] if p.vectors else None, p.status)]))


def detect(images: DataFrame, content: str, load: Load, min_confidence: float = 0.25, batch: int = BATCH) -> DataFrame:
    """The rows without their content, with status, detections (boxes at or above the confidence, the surest first), image_width and image_height."""
    steps = lambda pictures: _detected(pictures, load(), min_confidence, batch)
    own = lambda p: iter([(p.status, [{k: b.get(k) for k in BOX} for b in p.boxes], *_size_of(p))])
    return _through(images, content, f"status string, detections array<struct<{DETECTION.replace(' ', ':').replace(',:', ',')}>>, {SIZE}", steps, own)


def _share(box: dict, size: tuple[int, int] | None) -> float | None:
    """The share of the picture that a box covers, where the detector doesn't say."""
    if box.get("area_fraction") is not None or not size:
        return box.get("area_fraction")
    return (box["x2"] - box["x1"]) * (box["y2"] - box["y1"]) / (size[0] * size[1])


def _crop_rows(p: Picture, *more: Callable[[Picture, int], object]) -> Iterator[tuple]:
    if not p.boxes:
        yield (p.status, None, *(None for _ in BOX), *_size_of(p), *(None for _ in more))
    for k, b in enumerate(p.boxes):
        yield (p.status, k + 1, *(b[c] for c in BOX[:-1]), _share(b, p.size), *_size_of(p), *(m(p, k) for m in more))


CROPS = f"status string, detection_index int, {DETECTION}, {SIZE}"


def detect_and_crop(images: DataFrame, content: str, load: Load, cut: Cut, margin: float = 0.1, min_confidence: float = 0.25, top_only: bool = False, batch: int = BATCH) -> DataFrame:
    """A row for each crop, with the columns of its image but the content: status, detection_index, the box, the size of the image, crop.

    An image without detections, or that is corrupt, keeps a row without a crop. ``cut`` gives the bytes of a box
    (left, top, right, bottom) of an image, widened by the margin and clamped to its size where the header tells it.
    """
    require(margin >= 0, f"a margin must not be negative: {margin}")
    steps = lambda pictures: _cut(_detected(pictures, load(), min_confidence, batch), cut, margin, top_only)
    return _through(images, content, f"{CROPS}, crop binary", steps, lambda p: _crop_rows(p, lambda p, k: p.crops[k]), lambda p: 1 + sum(map(len, p.crops)))


def embedded_crops(images: DataFrame, content: str, detector: Load, cut: Cut, embedder: Load, margin: float = 0.1, min_confidence: float = 0.25, batch: int = BATCH) -> DataFrame:
    """The surest crop of each image and its embedding, in one pass: what a cache of embeddings holds; skipped images keep their status."""
    require(margin >= 0, f"a margin must not be negative: {margin}")
    steps = lambda pictures: _embedded(_cut(_detected(pictures, detector(), min_confidence, batch), cut, margin, True), embedder(), batch)
    return _through(images, content, f"{CROPS}, embedding array<float>", steps, lambda p: _crop_rows(p, lambda p, k: p.vectors[k]))


def stub_embedder(dim: int = 8) -> Callable[[list], list]:
    """A deterministic stand-in for a model: a vector from the digest of the content."""

    def model(contents: list) -> list:
        out = []
        for c in contents:
            out.append(None if not c else [(b - 127.5) / 127.5 for b in hashlib.sha256(bytes(c)).digest()[:dim]])
        return out

    return model


def stub_detector() -> Callable[[list], list]:
    """A deterministic stand-in for a detector: none to three boxes that follow from the number of bytes; nothing for no bytes."""

    def boxes(n: int) -> list[dict]:
        return [{"confidence": 0.3 * (k + 1), "x1": n % 40, "y1": n % 30, "x2": n % 40 + 20 + 10 * k, "y2": n % 30 + 10, "area_fraction": None} for k in range(n % 4)]

    return lambda contents: [boxes(len(c)) if c else None for c in contents]


def stub_cut(raw: bytes, box: tuple) -> bytes:
    """A deterministic stand-in for cutting: the bytes between the left and the right edge; an error where there are none."""
    left, _, right, _ = box
    if not raw[left:right]:
        raise ValueError("nothing there")
    return raw[left:right]


def stub_measure() -> Callable[[list], list]:
    """A deterministic stand-in for an embedder: the number of bytes, the first and the last of them."""
    return lambda crops: [[float(len(c)), float(c[0]), float(c[-1])] if c else None for c in crops]
