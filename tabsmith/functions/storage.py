"""Saving and loading of the library's own fitted models.

:class:`Stored` makes a ``pyspark.ml`` model writable from the constructor
arguments named in ``_fields``: numbers, texts, lists and arrays go into the
metadata file, nested models and DataFrames (as Parquet) into folders beside it.  Pipelines that hold such
models save and load as usual, in any later session.
"""

from __future__ import annotations

import base64

import numpy as np
from pyspark.ml import Model
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame

#: Larger arrays are written as bytes.
PLAIN_ARRAY = 1000


class _Writer(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        nested, frames = [], []

        def plain(v):
            if isinstance(v, DataFrame):
                frames.append(v)
                return {"frame": len(frames) - 1}
            if isinstance(v, Model):
                nested.append(v)
                return {"model": len(nested) - 1}
            if isinstance(v, np.ndarray):
                if v.size > PLAIN_ARRAY:
                    return {"bytes": base64.b64encode(np.ascontiguousarray(v).tobytes()).decode(), "dtype": str(v.dtype), "shape": list(v.shape)}
                return {"array": v.tolist(), "dtype": str(v.dtype)}
            if isinstance(v, np.generic):
                return v.item()
            if isinstance(v, (list, tuple)):
                return [plain(x) for x in v]
            return v

        state = {k: plain(getattr(self.instance, k)) for k in self.instance._fields}
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata={"state": state, "nested": len(nested)})
        for i, m in enumerate(nested):
            m.write().save(f"{path}/model-{i}")
        for i, df in enumerate(frames):
            df.write.mode("overwrite").parquet(f"{path}/frame-{i}")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        nested = [DefaultParamsReader.loadParamsInstance(f"{path}/model-{i}", self.sparkSession) for i in range(meta["nested"])]

        def back(v):
            if isinstance(v, dict):
                if "frame" in v:
                    return self.sparkSession.read.parquet(f"{path}/frame-{v['frame']}")
                if "bytes" in v:
                    return np.frombuffer(base64.b64decode(v["bytes"]), v["dtype"]).reshape(v["shape"])
                return nested[v["model"]] if "model" in v else np.array(v["array"], dtype=v["dtype"])
            return [back(x) for x in v] if isinstance(v, list) else v

        out = self.cls(*[back(meta["state"][k]) for k in self.cls._fields])
        out._resetUid(meta["uid"])
        return out


class Stored(MLWritable, MLReadable):
    """Mixin of models whose constructor takes the attributes in ``_fields``, in that order."""

    _fields: tuple = ()

    def write(self):
        return _Writer(self)

    @classmethod
    def read(cls):
        return _Reader(cls)
