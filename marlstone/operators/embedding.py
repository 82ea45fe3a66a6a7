"""Embeddings without a model: token hashes for text, byte histograms for images; and the place to plug models in."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens

#: bytes of a digest; longer vectors repeat it
PERIOD = 32


def normalized(vector: Column) -> Column:
    """Scaled to length 1; zero vectors stay."""
    v = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def hash_vector(token: Column, dim: int = PERIOD) -> Column:
    """The bytes of a token's SHA-256, less 127.5, repeated to ``dim`` numbers."""
    digest = F.sha2(token.cast("binary"), 256)
    return F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: F.conv(F.substring(digest, 2 * (i % PERIOD) + 1, F.lit(2)), 16, 10).cast("double") - 127.5,
    )


#: tokens whose digests are gathered at once: bounds a matrix at 32 times as many bytes
_TOKENS = 100_000
#: vectors that are scaled at once
_ROWS = 512


def _hash_sums(lists: pa.ListArray) -> np.ndarray:
    """For each list of tokens the sum of their digests' bytes, each less 127.5; every distinct token is hashed once."""
    sums = np.zeros((len(lists), PERIOD))
    words = lists.flatten().dictionary_encode()
    if not len(words):
        return sums
    digests = b"".join(hashlib.sha256(w.encode()).digest() for w in words.dictionary.to_pylist())
    table = np.frombuffer(digests, np.uint8).reshape(-1, PERIOD)
    number = words.indices.to_numpy()
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    some = np.flatnonzero(size)
    ends = np.cumsum(size[some])
    lo = 0
    while lo < len(some):
        first = ends[lo] - size[some[lo]]
        hi = max(lo + 1, int(np.searchsorted(ends, first + _TOKENS, "right")))
        total = np.add.reduceat(table[number[first : ends[hi - 1]]], ends[lo:hi] - size[some[lo:hi]] - first, dtype=np.int64)
        sums[some[lo:hi]] = total - 127.5 * size[some[lo:hi], None]
        lo = hi
    return sums


def _lists(rows: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as lists, without a copy."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.reshape(-1)))


def hash_embed(text: Column, dim: int = 384) -> Column:
    """Mean of a text's token hashes, scaled to length 1, as ``array<double>``; zeros without tokens.

    The vector repeats every 32 numbers, so any multiple of 32 gives the same cosines. Tokens come from the JVM; an
    Arrow function hashes the distinct ones of a batch and adds them up as a matrix.
    """

    @F.arrow_udf("array<double>")
    def embed(words: pa.Array) -> pa.Array:
        sums = _hash_sums(words)
        out = np.empty((len(sums), dim))
        for at in range(0, len(sums), _ROWS):
            v = np.tile(sums[at : at + _ROWS], -(-dim // PERIOD))[:, :dim]
            norm = np.sqrt((v * v).sum(1, keepdims=True))
            out[at : at + _ROWS] = v / np.where(norm > 0, norm, 1)
        return _lists(out)

    return embed(tokens(F.coalesce(text, F.lit(""))))


def hash_image_embed(content: Column, path: Column, dim: int = 512) -> Column:
    """Byte histogram of a file (of its path, if unreadable) repeated to ``dim``, a little of the path's hash, scaled to length 1."""

    @F.arrow_udf("array<double>")
    def embed(data: pa.Array, names: pa.Array) -> pa.Array:
        out = np.empty((len(names), dim))
        byte, period = np.arange(dim) % 256, np.arange(dim) % PERIOD
        for i, (raw, name) in enumerate(zip(data, names)):  # one file at a time as bytes of Python
            name, raw = name.as_py().encode(), raw.as_py()
            v = np.bincount(np.frombuffer(name if raw is None else raw, np.uint8), minlength=256).astype(float)[byte]
            v += 0.01 * (np.frombuffer(hashlib.sha256(name).digest(), np.uint8) - 127.5)[period]
            norm = np.linalg.norm(v)
            out[i] = v / norm if norm else v
        return _lists(out)

    return embed(content, path)


def model_embed(column: Column, load: Callable[[], Callable[[list], np.ndarray]], batch_size: int = 16) -> Column:
    """Embed with a model: ``load`` runs once per task and returns a function from a list of inputs to a matrix; rows are scaled to length 1. Nulls stay null."""

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for values in batches:
            size = batch_size if batch_size > 0 else max(1, len(values))
            out = pd.Series([None] * len(values), dtype=object)
            some = [i for i, x in enumerate(values) if x is not None]
            for lo in range(0, len(some), size):
                part = some[lo : lo + size]
                m = np.asarray(encode([values.iloc[i] for i in part]), float)
                norm = np.linalg.norm(m, axis=1, keepdims=True)
                for i, v in zip(part, m / np.where(norm > 0, norm, 1)):
                    out.iloc[i] = v
            yield out

    return embed(column)


def vision_backend(model: str, backend: str = "auto") -> str:
    """Which wrapper a vision model needs: ``hash``, ``clip`` or ``qwen``."""
    if model == "hash":
        return "hash"
    if backend in ("clip", "qwen"):
        return backend
    return "qwen" if any(s in model.lower() for s in ("qwen", "gme")) else "clip"


#: models that a program plugs in by name: (of texts, of the bytes of images), loaders as ``model_embed`` takes them
PLUGGED: dict[str, tuple[Callable | None, Callable | None]] = {}


def plug(name: str, texts: Callable | None = None, images: Callable | None = None) -> None:
    """Make a model known under a name that the settings may then give as text or vision model."""
    PLUGGED[name] = (texts, images)


def _missing(name: str, needs: str, error: ImportError) -> ImportError:
    return ImportError(f"the model {name} needs {needs} on the executors, or a loader given to plug()").with_traceback(error.__traceback__)


def _sentence_model(name: str) -> Callable:
    def load():
        try:
            from sentence_transformers import SentenceTransformer
        except ImportError as e:
            raise _missing(name, "sentence-transformers", e) from e
        model = SentenceTransformer(name)
        return lambda texts: model.encode(texts, show_progress_bar=False)

    return load


def _vision_model(name: str, family: str, instruction: str, of_texts: bool) -> Callable:
    """A multimodal model of the transformers library. ``clip`` has features of images and texts, ``qwen`` embeddings, its questions after an instruction."""

    def load():
        try:
            import io

            import torch
            from PIL import Image
            from transformers import AutoModel, AutoProcessor
        except ImportError as e:
            raise _missing(name, "torch, transformers and pillow", e) from e
        device = "cuda" if torch.cuda.is_available() else "cpu"
        model = AutoModel.from_pretrained(name, trust_remote_code=family == "qwen").to(device).eval()
        opened = lambda files: [Image.open(io.BytesIO(f)).convert("RGB") for f in files]
        if family == "qwen":
            ask = (lambda texts: model.get_text_embeddings(texts=texts, instruction=instruction)) if of_texts else (lambda files: model.get_image_embeddings(images=opened(files)))
        else:
            reader = AutoProcessor.from_pretrained(name)
            ask = (
                (lambda texts: model.get_text_features(**reader(text=texts, return_tensors="pt", padding=True, truncation=True).to(device)))
                if of_texts
                else (lambda files: model.get_image_features(**reader(images=opened(files), return_tensors="pt").to(device)))
            )

        def encode(items):
            with torch.no_grad():
                out = ask(items)
            return out.float().cpu().numpy() if hasattr(out, "cpu") else np.asarray(out)

        return encode

    return load


def text_vectors(text: Column, model: str = "hash", dim: int = 384) -> Column:
    """Vectors of texts by the text model that the settings name."""
    if model == "hash":
        return hash_embed(text, dim)
    load = PLUGGED[model][0] if model in PLUGGED else _sentence_model(model)
    return model_embed(F.coalesce(text, F.lit("")), load)


def tile_vectors(content: Column, path: Column, model: str = "hash", dim: int = 512, family: str = "auto", batch: int = 16) -> Column:
    """Vectors of image files by the vision model that the settings name; a file that cannot be read has none with a model, so its tile is not found."""
    family = vision_backend(model, family)
    if family == "hash":
        return hash_image_embed(content, path, dim)
    load = PLUGGED[model][1] if model in PLUGGED else _vision_model(model, family, "", False)
    return model_embed(content, load, batch)


def question_vectors(text: Column, model: str = "hash", dim: int = 512, family: str = "auto", batch: int = 16, instruction: str = "") -> Column:
    """Vectors of questions in the space of the vision model's tiles."""
    family = vision_backend(model, family)
    if family == "hash":
        return hash_embed(text, dim)
    load = PLUGGED[model][0] if model in PLUGGED else _vision_model(model, family, instruction, True)
    return model_embed(F.coalesce(text, F.lit("")), load, batch)


def long_form(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, i, value): a row per component."""
    return df.select(id_col, F.posexplode(vector_col).alias("i", "value"))
