"""Settings of a run: from a YAML file, from the command line, or by hand."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from rasterloom.operators.bands import requested_bands
from rasterloom.operators.crop import parse_bbox
from rasterloom.sources.files import read_yaml


def truth(value) -> bool:
    """A boolean from YAML or the command line; "false", "no", "0" and "" are false."""
    if isinstance(value, list | tuple):
        return any(truth(v) for v in value)
    return value if isinstance(value, bool) else str(value).strip().lower() not in ("", "0", "false", "no", "none")


@dataclass
class Settings:
    """What to segment, with which model, and what to make of it."""

    image: str = ""
    model: str | None = None
    bands: list[int] = field(default_factory=list)
    band_names: list[str] = field(default_factory=list)
    bbox: tuple[float, ...] | None = None
    work_dir: str | None = None
    vec: bool = False
    yolo: bool = False
    coco: bool = False
    patch_size: int = 1024
    classes: int = 5
    threshold: float = 0.3
    tta: str = "identity"
    device: str = "cpu"
    gpu_id: int = 0

    def __post_init__(self) -> None:
        if self.patch_size < 2 or self.patch_size % 2:
            raise ValueError("the patch size must be an even number of pixels")
        if self.classes < 1:
            raise ValueError("at least one class is needed")


def augmentation(on, flip, rotate) -> str:
    """Which variants are averaged; switched on without flip or rotation there is only the patch itself."""
    if not truth(on):
        return "identity"
    return {(True, True): "d4", (True, False): "flip", (False, True): "rotate"}.get((truth(flip), truth(rotate)), "identity")


def from_arguments(a: dict) -> Settings:
    """Settings from the keys that a YAML file or the command line gives."""
    none = lambda v: None if v in (None, "None", "") else v
    asked = a.get("bands_requested")
    listed = asked if isinstance(asked, list) else [x for x in str(asked or "").strip("[] ").split(",") if x.strip()]
    names = [str(x).strip() for x in listed if not str(x).strip().isdigit()]
    return Settings(
        image=str(a.get("image") or ""),
        model=none(a.get("model")),
        bands=[] if names else requested_bands(listed),
        band_names=names,
        bbox=parse_bbox(none(a.get("bbox"))),
        work_dir=none(a.get("work_dir")),
        vec=truth(a.get("vec", False)),
        yolo=truth(a.get("yolo", False)),
        coco=truth(a.get("coco", False)),
        patch_size=int(a.get("patch_size") or 1024),
        classes=int(a.get("classes") or 5),
        threshold=float(a.get("prediction_thr") if a.get("prediction_thr") is not None else 0.3),
        tta=augmentation(a.get("transformers", False), a.get("transformer_flip", False), a.get("transformer_rotate", False)),
        device=str(a.get("device") or "cpu"),
        gpu_id=int(a.get("gpu_id") or 0),
    )


def from_yaml(path: str) -> Settings:
    return from_arguments(read_yaml(path)["arguments"])


def from_command_line(argv: Sequence[str]) -> Settings:
    """Settings from ``-a file.yaml``, or from ``-i image`` and further flags."""
    import argparse

    p = argparse.ArgumentParser(prog="rasterloom", description="Segment an image and turn the mask into labels.")
    p.add_argument("-a", "--args", help="a YAML file; other flags are then ignored")
    p.add_argument("-i", "--image")
    p.add_argument("-bb", "--bbox")
    p.add_argument("-br", "--bands_requested")
    p.add_argument("-m", "--model")
    p.add_argument("-wd", "--work_dir")
    p.add_argument("-ps", "--patch_size", type=int, default=1024)
    for short, long in (("-v", "--vec"), ("-y", "--yolo"), ("-c", "--coco"), ("-mg", "--mgpu"), ("-tr", "--transformers"), ("-tf", "--transformer_flip"), ("-tt", "--transformer_rotate")):
        p.add_argument(short, long, nargs="?", const=True, default=False)
    p.add_argument("-d", "--device", default="cpu")
    p.add_argument("-id", "--gpu_id", type=int, default=0)
    p.add_argument("-cls", "--classes", type=int, default=5)
    p.add_argument("-w", "--workers", type=int, default=0)
    p.add_argument("-pr", "--prediction_thr", type=float, default=0.3)
    found = vars(p.parse_args(list(argv)))
    if found["args"]:
        return from_yaml(found["args"])
    if not found["image"]:
        p.exit(2, "give a YAML file with -a or an image with -i\n")
    return from_arguments(found)
