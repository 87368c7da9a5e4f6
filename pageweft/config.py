"""Settings of the page pipeline and of a service instance, with their defaults and the environment's overrides."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace
from pathlib import Path

from .functions import labels as L


@dataclass(frozen=True)
class PipelineConfig:
    layout_threshold: float = 0.3
    layout_nms: bool = True
    nms_threshold: float = 0.5
    layout_unclip_ratio: float = 1.0
    crop_padding_ratio: float = 0.0
    merge_layout_blocks: bool = True
    use_chart_recognition: bool = False
    use_seal_recognition: bool = False
    use_ocr_for_image_block: bool = False
    max_tokens: int = 4096
    use_orientation: bool = True
    use_unwarping: bool = True
    include_markdown: bool = True
    markdown_ignored: tuple[str, ...] = tuple(L.MARKDOWN_IGNORED)
    pipeline_version: str = "v1.6"
    vl_model: str = "recognizer"
    layout_model: str = "detector"
    device: str = "cpu"


@dataclass(frozen=True)
class ApiConfig:
    bind_addr: str = "0.0.0.0:8080"
    models_dir: str = "models"
    max_upload_mb: int = 20
    inference_queue_depth: int = 8
    pipeline: PipelineConfig = field(default_factory=PipelineConfig)


def _flag(text: str) -> bool:
    """Only 1 and true are true; any other set value is false."""
    return text == "1" or text.lower() == "true"


def _count(text: str) -> int:
    """A whole number without a minus sign."""
    if not text.isascii() or not text.removeprefix("+").isdigit():
        raise ValueError(text)
    return int(text)


def _number(kind, text: str, default):
    try:
        return kind(text)
    except ValueError:
        return default


def env_file(path: str) -> dict[str, str]:
    """NAME=value lines of a file; comments, blank lines and an export before the name are allowed, as are quotes around
    the value. A missing file has none."""
    out: dict[str, str] = {}
    for line in Path(path).read_text().splitlines() if Path(path).is_file() else ():
        name, mark, value = line.strip().removeprefix("export ").partition("=")
        if mark and not name.startswith("#"):
            value = value.strip()
            out.setdefault(name.strip(), value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value.split(" #")[0].rstrip())
    return out


DEVICES = ("cpu", "cuda", "metal")


def device(text: str | None, available: tuple[str, ...] = ("cpu",)) -> str:
    """The device that BACKEND names: nothing means the CPU, 'auto' the first of CUDA, Metal and CPU that is available.
    Any other name, and a device that isn't available, is an error."""
    name = (text or "").strip().lower() or "cpu"
    if name == "auto":
        return next((d for d in ("cuda", "metal") if d in available), "cpu")
    if name not in DEVICES:
        raise ValueError(f"invalid BACKEND={name!r}; expected cpu, cuda, metal, or auto")
    if name != "cpu" and name not in available:
        raise ValueError(f"BACKEND={name}, but no such device is available")
    return name


def from_env(env: dict[str, str] | None = None, dotenv: str | None = None, available: tuple[str, ...] = ("cpu",)) -> ApiConfig:
    """Settings from environment variables and, where they don't set one, from a ``dotenv`` file; values that can't be read
    leave the default."""
    env = dict(os.environ) if env is None else env
    env = (env_file(dotenv) if dotenv else {}) | env
    p, a = PipelineConfig(), ApiConfig()
    spec = {
        "max_tokens": ("MAX_TOKENS", _count), "layout_unclip_ratio": ("LAYOUT_UNCLIP_RATIO", float), "crop_padding_ratio": ("CROP_PADDING_RATIO", float),
        "layout_threshold": ("LAYOUT_THRESHOLD", float), "layout_nms": ("LAYOUT_NMS", _flag), "merge_layout_blocks": ("MERGE_LAYOUT_BLOCKS", _flag),
        "use_orientation": ("USE_DOC_ORIENTATION_CLASSIFY", _flag), "use_unwarping": ("USE_DOC_UNWARPING", _flag),
    }
    p = replace(p, **{k: _number(kind, env[name], getattr(p, k)) for k, (name, kind) in spec.items() if name in env})
    p = replace(p, device=device(env.get("BACKEND"), available))
    own = {"bind_addr": ("BIND_ADDR", str), "models_dir": ("MODELS_DIR", str), "max_upload_mb": ("MAX_UPLOAD_MB", _count), "inference_queue_depth": ("INFERENCE_QUEUE_DEPTH", _count)}
    return replace(a, pipeline=p, **{k: _number(kind, env[name], getattr(a, k)) for k, (name, kind) in own.items() if name in env})
