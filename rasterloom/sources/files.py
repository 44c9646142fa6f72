"""Files on the driver: work folders, archives, downloads, models."""

from __future__ import annotations

import logging
import os
import tarfile
import urllib.request
from pathlib import Path
from urllib.parse import urlparse

import yaml

log = logging.getLogger(__name__)
DEFAULT = Path.home() / ".cache" / "rasterloom"


def read_yaml(path: str | Path) -> dict:
    return yaml.safe_load(Path(path).read_text())


def work_folder(path: str | Path | None) -> Path:
    """The folder, made if missing; a default below the user's cache for None."""
    folder = Path(path) if path and str(path) != "None" else DEFAULT
    folder.mkdir(parents=True, exist_ok=True)
    return folder


def extract_tar(archive: str | Path, folder: str | Path) -> list[str]:
    """Regular members by their bare names into ``folder``; the archive goes.  A broken archive is logged and stays."""
    done = []
    try:
        with tarfile.open(archive, "r:gz") as tar:
            for member in tar:
                name = os.path.basename(member.name)
                if member.isfile() and name not in ("", ".", ".."):
                    with tar.extractfile(member) as source:
                        (Path(folder) / name).write_bytes(source.read())
                    done.append(name)
    except tarfile.TarError as e:
        log.error("%s can't be unpacked: %s", archive, e)
        return done
    os.remove(archive)
    return done


def download(url: str, path: str | Path, token: str | None = None) -> bool:
    """The URL's bytes at ``path``; whether that worked (if not, it is logged)."""
    ask = urllib.request.Request(url, headers={"Authorization": f"Bearer {token}"} if token else {})
    try:
        with urllib.request.urlopen(ask) as answer:
            Path(path).write_bytes(answer.read())
    except OSError as e:
        log.error("%s can't be had: %s", url, e)
        return False
    return True


def model_file(model: str, folder: str | Path) -> str:
    """A model's local path: a URL is downloaded once, by its last name; ValueError for anything that isn't there."""
    text = str(model)
    if Path(text).is_file():
        return text
    if urlparse(text).scheme in ("http", "https"):
        path = work_folder(folder) / os.path.basename(urlparse(text).path)
        if path.exists() or download(text, path):
            return str(path)
    raise ValueError(f"Invalid model path: {text}")
