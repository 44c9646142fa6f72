"""Models and patch inference (M1, M2, M6-M8).

A model maps patches (n, bands, P, P) to scores (n, classes, P, P).  Those that are plain
formulas also come as column expressions, so that small jobs stay inside Spark SQL.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.functions.geometry import let

MEAN, STD = (0.405, 0.432, 0.397), (0.164, 0.173, 0.153)


class Model(Protocol):
    classes: int

    def predict(self, patches: np.ndarray) -> np.ndarray: ...


def softmax(logits: Column) -> Column:
    """Softmax of an array of any length, every part of it computed once."""
    exps = let(F.array_max(logits), lambda top: F.transform(logits, lambda v: F.exp(v - top)))
    return let(exps, lambda e: let(F.aggregate(e, F.lit(0.0), lambda s, x: s + x), lambda total: F.transform(e, lambda v: v / total)))


def softmax_of(logits: Sequence[Column]) -> Column:
    """The same for logits known one by one: plain expressions, which generated code shares."""
    if len(logits) == 1:
        return F.array(F.lit(1.0))
    top = F.greatest(*logits)
    exps = [F.exp(z - top) for z in logits]
    total = exps[0]
    for e in exps[1:]:
        total = total + e
    return F.array(*(e / total for e in exps))


def sigmoid(v: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-v))


def normalize_bands(bands: Column, mean: Sequence[float] = MEAN, std: Sequence[float] = STD, low: float = 0.0, high: float = 255.0, to: tuple[float, float] = (0.0, 1.0)) -> Column:
    """Rescale low..high to ``to``, then standardize band by band."""
    scaled = lambda v: F.lit(to[1] - to[0]) * (v - F.lit(low)) / F.lit(high - low) + F.lit(to[0])
    return F.array(*((scaled(bands[k]) - F.lit(float(m))) / F.lit(float(s)) for k, (m, s) in enumerate(zip(mean, std, strict=True))))


@dataclass(frozen=True)
class LinearSoftmax:
    """Softmax (one class: sigmoid) of a linear map of each pixel's bands, less the patch's mean if ``centred``."""

    weights: tuple[tuple[float, ...], ...]
    bias: tuple[float, ...]
    centred: bool = False

    @property
    def classes(self) -> int:
        return len(self.bias)

    def predict(self, patches: np.ndarray) -> np.ndarray:
        x = patches - patches.mean(axis=(2, 3), keepdims=True) if self.centred else patches
        z = np.einsum("kc,nchw->nkhw", np.array(self.weights), x) + np.array(self.bias)[None, :, None, None]
        if self.classes == 1:
            return 1 / (1 + np.exp(-z))
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def columns(self, patches: DataFrame) -> DataFrame:
        """``patches`` with a column ``probs``; a centred model needs the patches' means, over windows of one patch each."""
        count = len(self.weights[0])
        keys = ["raster_id", "patch_row", "patch_col"]
        x = [F.col("bands")[c] for c in range(count)]
        if self.centred:
            patch = Window.partitionBy(*keys)
            patches = patches.withColumns({f"mean_{c}": F.avg(F.col("bands")[c]).over(patch) for c in range(count)})
            x = [v - F.col(f"mean_{c}") for c, v in enumerate(x)]
        logits = []
        for w, b in zip(self.weights, self.bias, strict=True):
            z = F.lit(float(b))
            for k, v in zip(w, x, strict=True):
                z = z + F.lit(float(k)) * v
            logits.append(z)
        probs = F.array(sigmoid(logits[0])) if self.classes == 1 else softmax_of(logits)
        return patches.withColumn("probs", probs).drop(*(f"mean_{c}" for c in range(count) if self.centred))


@dataclass(frozen=True)
class Constant:
    """The same class everywhere."""

    cls: int
    classes: int = 5

    def predict(self, patches: np.ndarray) -> np.ndarray:
        out = np.zeros((len(patches), self.classes, *patches.shape[2:]))
        out[:, self.cls] = 1.0
        return out


@dataclass
class FileModel:
    """A network in a file, opened once per worker.

    ``shipped`` sends the file to the executors with the job (``SparkContext.addFile``), so it only has to
    lie on the driver's disk.
    """

    path: str
    classes: int
    device: str = "cpu"
    gpu_id: int = 0
    sent: bool = False
    _session: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {k: v for k, v in vars(self).items() if k != "_session"} | {"_session": None}

    def shipped(self, spark: SparkSession) -> FileModel:
        spark.sparkContext.addFile(self.path)
        return replace(self, sent=True, _session=None)

    def local_path(self) -> str:
        return SparkFiles.get(os.path.basename(self.path)) if self.sent else self.path


@dataclass
class TorchModel(FileModel):
    """A TorchScript module; torch is imported by the workers that run it."""

    def predict(self, patches: np.ndarray) -> np.ndarray:
        import torch

        device = chosen_device(self.device, self.gpu_id)
        if self._session is None:
            self._session = torch.jit.load(self.local_path(), map_location=device).eval()
        with torch.no_grad():
            out = self._session(torch.from_numpy(np.ascontiguousarray(patches, np.float32)).to(device))
        return np.asarray(out.cpu().numpy(), dtype=float)


@dataclass
class OnnxModel(FileModel):
    """A network in an ONNX file."""

    def predict(self, patches: np.ndarray) -> np.ndarray:
        if self._session is None:
            import onnxruntime

            device = chosen_device(self.device, self.gpu_id)
            gpu = [("CUDAExecutionProvider", {"device_id": int(device[5:])})] if device != "cpu" and "CUDAExecutionProvider" in onnxruntime.get_available_providers() else []
            self._session = onnxruntime.InferenceSession(self.local_path(), providers=[*gpu, "CPUExecutionProvider"])
        name = self._session.get_inputs()[0].name
        return np.asarray(self._session.run(None, {name: patches.astype(np.float32)})[0], dtype=float)


def file_model(path: str, classes: int, device: str = "cpu", gpu_id: int = 0) -> FileModel:
    """TorchScript for ``.pt``, ``.pth`` and ``.torchscript`` files, else ONNX."""
    kind = TorchModel if path.lower().endswith((".pt", ".pth", ".torchscript")) else OnnxModel
    return kind(path, classes, device, gpu_id)


#: Elements of the square's symmetry group that an augmentation averages over: (quarter turns, mirror first).
VARIANTS = {"identity": [(0, False)], "d4": [(k, m) for m in (False, True) for k in range(4)], "rotate": [(0, False), (1, False)], "flip": [(0, False), (0, True), (2, False), (2, True)]}


@dataclass
class Augmented:
    """The mean of a model's scores over variants of the patch, each turned back."""

    model: Model
    kind: str = "d4"

    @property
    def classes(self) -> int:
        return self.model.classes

    def predict(self, patches: np.ndarray) -> np.ndarray:
        total = 0.0
        for turns, mirror in VARIANTS[self.kind]:
            x = patches[..., ::-1] if mirror else patches
            p = np.rot90(self.model.predict(np.ascontiguousarray(np.rot90(x, turns, axes=(2, 3)))), -turns, axes=(2, 3))
            total = total + (p[..., ::-1] if mirror else p)
        return total / len(VARIANTS[self.kind])


def augment(patches: DataFrame, s: int, kind: str) -> DataFrame:
    """Every patch pixel once for each variant: ``variant``, and its place (ty, tx) in the varied patch."""
    last = F.lit(2 * s - 1)
    x = F.when(F.col("v.mirror"), last - F.col("px")).otherwise(F.col("px"))
    y = F.col("py")
    ty = F.when(F.col("v.turns") == 0, y).when(F.col("v.turns") == 1, last - x).when(F.col("v.turns") == 2, last - y).otherwise(x)
    tx = F.when(F.col("v.turns") == 0, x).when(F.col("v.turns") == 1, y).when(F.col("v.turns") == 2, last - x).otherwise(last - y)
    options = F.array(*(F.struct(F.lit(n).alias("variant"), F.lit(t).alias("turns"), F.lit(m).alias("mirror")) for n, (t, m) in enumerate(VARIANTS[kind])))
    return patches.withColumn("v", F.explode(options)).withColumns({"ty": ty, "tx": tx, "variant": F.col("v.variant")}).drop("v")


def merge_variants(scores: DataFrame) -> DataFrame:
    """The mean over variants of (raster_id, patch_row, patch_col, py, px, variant, p), back at the pixels' own places."""
    return scores.groupBy("raster_id", "patch_row", "patch_col", "py", "px").agg(F.avg("p").alias("p"))


def predict_patches(patches: DataFrame, model: Model, s: int, count: int) -> DataFrame:
    """(raster_id, patch_row, patch_col, py, px, probs) by running the model on whole patches in numpy."""
    size = 2 * s

    def run(key: tuple, table: pa.Table) -> pa.Table:
        at = table.column("py").to_numpy() * size + table.column("px").to_numpy()
        bands = np.array(table.column("bands").combine_chunks().values).reshape(-1, count)
        x = np.zeros((size * size, count))
        x[at] = bands
        p = model.predict(x.T.reshape(1, count, size, size))[0]
        if p.shape[1:] != (size, size):
            p = np.zeros((model.classes, size, size))
        place = np.arange(size * size)
        probs = pa.ListArray.from_arrays(pa.array(np.arange(size * size + 1, dtype=np.int32) * model.classes), pa.array(p.reshape(model.classes, -1).T.ravel()))
        keys = [pa.array([k.as_py()] * len(place), k.type) for k in key]
        return pa.Table.from_arrays([*keys, pa.array(place // size, pa.int32()), pa.array(place % size, pa.int32()), probs], names=["raster_id", "patch_row", "patch_col", "py", "px", "probs"])

    kinds = [patches.schema[n].dataType.simpleString() for n in ("raster_id", "patch_row", "patch_col")]
    schema = f"raster_id {kinds[0]}, patch_row {kinds[1]}, patch_col {kinds[2]}, py int, px int, probs array<double>"
    return patches.groupBy("raster_id", "patch_row", "patch_col").applyInArrow(run, schema)


def gpu_stats(devices: DataFrame) -> DataFrame:
    """(gpu, memory_used, memory_total, load) of (gpu, memory_free, memory_total, load): used is what isn't free (M5)."""
    return devices.select("gpu", (F.col("memory_total") - F.col("memory_free")).alias("memory_used"), "memory_total", "load")


def pick_device(stats: DataFrame, wanted: str = "gpu", limit: float = 70.0) -> DataFrame:
    """The first device below ``limit`` percent of memory and load, of (gpu, memory_used, memory_total, load)."""
    free = (100 * F.col("memory_used") / F.col("memory_total") < limit) & (F.col("load") < limit)
    return stats.agg(F.min(F.when(free, F.col("gpu"))).alias("gpu")).select(F.coalesce(F.concat(F.lit("cuda:"), F.col("gpu").cast("string")), F.lit(wanted)).alias("device"))


def visible_devices() -> list[tuple[int, float, float, float]]:
    """(gpu, free MB, all MB, load) of this machine's devices as its driver tool lists them; none without the tool."""
    import subprocess

    try:
        told = subprocess.run(["nvidia-smi", "--query-gpu=index,memory.free,memory.total,utilization.gpu", "--format=csv,noheader,nounits"], capture_output=True, text=True, timeout=30, check=True)
    except (OSError, subprocess.SubprocessError):
        return []
    return [(int(r[0]), *map(float, r[1:])) for r in (line.split(", ") for line in told.stdout.splitlines() if line.strip())]


def chosen_device(wanted: str, gpu_id: int = 0, devices: Sequence[tuple[int, float, float, float]] | None = None, limit: float = 70.0) -> str:
    """The device that a worker runs its model on: ``cpu``, or ``cuda:k`` with the first device below ``limit`` percent.

    ``gpu_id`` is tried first; without a device that is free enough the model runs on the CPU.
    """
    if not wanted.startswith(("gpu", "cuda")):
        return "cpu"
    found = visible_devices() if devices is None else devices
    free = [d[0] for d in found if 100 * (d[2] - d[1]) / d[2] < limit and d[3] < limit]
    return f"cuda:{gpu_id if gpu_id in free else free[0]}" if free else "cpu"
