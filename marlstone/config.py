"""Engine settings, in one group per operator; unknown keys of a settings file are kept in ``extra``."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace
from typing import Any


@dataclass(frozen=True)
class Storage:
    folder: str = ".marlstone"


@dataclass(frozen=True)
class Chunks:
    size: int = 800
    overlap: int = 120


@dataclass(frozen=True)
class TextModel:
    name: str = "hash"
    dim: int = 384


@dataclass(frozen=True)
class VisionModel:
    name: str = "hash"
    dim: int = 512
    family: str = "auto"
    batch: int = 16
    instruction: str = "Find a document page that answers the query."


@dataclass(frozen=True)
class Tiles:
    height: int = 512
    overlap: int = 64
    width: int = 1280
    scale: float = 1.0
    fold: str = "doc"
    fold_by: str = "exact"


@dataclass(frozen=True)
class Pixels:
    mode: str = "auto"
    threshold: float = 0.35
    text_share: float = 0.7


@dataclass(frozen=True)
class Fusion:
    top_k: int = 10
    method: str = "rrf"
    rank_offset: int = 60
    norm: str = "minmax"
    temperature: float = 0.1
    text_weight: float = 1.0
    vision_weight: float = 1.0


@dataclass(frozen=True)
class Router:
    on: bool = True
    kind: str = "heuristic"
    weights_file: str = ""


@dataclass(frozen=True)
class Rerank:
    on: bool = False
    model: str = "lexical"
    depth: int = 30
    blend: float = 0.5


@dataclass(frozen=True)
class Answers:
    reader: str = "extractive"
    sentences: int = 3
    hits: int = 5


#: fixed values: the keys of a settings file, and what they set. The defaults above must match what files leave out.
KEYS = {
    "storage_dir": "storage.folder",
    "chunk_size": "chunks.size", "chunk_overlap": "chunks.overlap",
    "text_model": "text.name", "text_dim": "text.dim",
    "vision_model": "vision.name", "vision_dim": "vision.dim", "vision_backend": "vision.family", "vision_batch_size": "vision.batch", "vision_query_instruction": "vision.instruction",
    "tile_height": "tiles.height", "tile_overlap": "tiles.overlap", "viewport_width": "tiles.width", "render_scale": "tiles.scale", "tile_dedup": "tiles.fold", "tile_dedup_method": "tiles.fold_by",
    "pixel_selection": "pixels.mode", "pixel_selection_threshold": "pixels.threshold", "pixel_selection_text_weight": "pixels.text_share",
    "top_k": "fusion.top_k", "fusion_method": "fusion.method", "rrf_k": "fusion.rank_offset", "fusion_norm": "fusion.norm", "fusion_softmax_temp": "fusion.temperature",
    "text_weight": "fusion.text_weight", "vision_weight": "fusion.vision_weight",
    "enable_router": "router.on", "router_model": "router.kind", "router_weights_path": "router.weights_file",
    "enable_rerank": "rerank.on", "rerank_model": "rerank.model", "rerank_top_n": "rerank.depth", "rerank_blend": "rerank.blend",
    "reader_model": "answers.reader", "answer_max_sentences": "answers.sentences", "answer_top_k": "answers.hits",
}


@dataclass(frozen=True)
class EngineConfig:
    storage: Storage = Storage()
    chunks: Chunks = Chunks()
    text: TextModel = TextModel()
    vision: VisionModel = VisionModel()
    tiles: Tiles = Tiles()
    pixels: Pixels = Pixels()
    fusion: Fusion = Fusion()
    router: Router = Router()
    rerank: Rerank = Rerank()
    answers: Answers = Answers()
    extra: dict[str, Any] = field(default_factory=dict)

    def get(self, key: str) -> Any:
        """A setting by its key in a settings file."""
        group, name = KEYS[key].split(".")
        return getattr(getattr(self, group), name)

    def with_settings(self, **changes: Any) -> EngineConfig:
        """A copy with settings changed by their keys in a settings file."""
        groups: dict[str, dict[str, Any]] = {}
        for key, value in changes.items():
            if key not in KEYS:
                raise KeyError(f"no setting {key!r}")
            group, name = KEYS[key].split(".")
            groups.setdefault(group, {})[name] = value
        return replace(self, **{g: replace(getattr(self, g), **own) for g, own in groups.items()})

    @classmethod
    def from_dict(cls, data: dict[str, Any]) -> EngineConfig:
        extra = {**data.get("extra", {}), **{k: v for k, v in data.items() if k not in KEYS and k != "extra"}}
        return replace(cls().with_settings(**{k: v for k, v in data.items() if k in KEYS}), extra=extra)

    @classmethod
    def from_file(cls, path: str) -> EngineConfig:
        with open(path, encoding="utf-8") as f:
            return cls.from_dict(json.load(f))

    def to_dict(self) -> dict[str, Any]:
        return {k: self.get(k) for k in KEYS} | {"extra": self.extra}

    def to_file(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(self.to_dict(), f, indent=2)


assert all(hasattr(getattr(EngineConfig(), v.split(".")[0]), v.split(".")[1]) for v in KEYS.values())
assert len(KEYS) == sum(len(fields(getattr(EngineConfig(), f.name))) for f in fields(EngineConfig) if f.name != "extra")
