"""The default parts of the engine, by the names that an extension replaces them under, and the loader of extensions."""

from __future__ import annotations

import importlib
import logging
import os

from pyspark.sql import SparkSession

from quillstone import registry
from quillstone.operators import artifacts, chunk, context, ingest, parse, retrieve
from quillstone.sources import files

DEFAULT, BUILT_IN = 50, 100


def parser_of(hint: str | None = None):
    """The parser that a hint names, else the default one."""
    name = f"parser:{hint}"
    return registry.get(name) if hint and name in registry.names() else registry.get("parser:default")


def register_defaults() -> None:
    registry.register("chunker", chunk.text_chunks, BUILT_IN)
    registry.register("html_parser", parse.html_fields, BUILT_IN)
    registry.register("pdf_extractor", files.no_pages, BUILT_IN)
    registry.register("vlm_describer", ingest.no_description, BUILT_IN)
    registry.register("embedder", ingest.hashed_embedding, BUILT_IN)
    registry.register("retriever", retrieve.retrieve, BUILT_IN)
    registry.register("reranker", retrieve.rerank, BUILT_IN)
    registry.register("hybrid_selector", retrieve.hybrid, BUILT_IN)
    registry.register("prompt_builder", context.prompts, BUILT_IN)
    registry.register("parser_router", parser_of, BUILT_IN)
    registry.register("parser:default", parse.default_elements, DEFAULT)
    registry.register("parser:structural", parse.structural_elements, 2 * BUILT_IN)
    registry.register("detector", files.detect, BUILT_IN)
    registry.register("ocr_preprocessor", files.no_layer, BUILT_IN)
    registry.register("renderer:markdown", artifacts.markdown, BUILT_IN)


def load_extensions(names: str, spark: SparkSession | None = None) -> list[str]:
    """Imports the modules of a comma-separated list and calls their register(registry), if they have one; one that fails is passed over. The names of those that loaded. With a session, a module that is one file is
    sent to the executors, so that what it registers can run there."""
    loaded = []
    for name in filter(None, (n.strip() for n in names.split(","))):
        try:
            module = importlib.import_module(name)
            if hasattr(module, "register"):
                module.register(registry)
            if spark is not None and os.path.basename(getattr(module, "__file__", None) or "") == f"{name}.py":
                spark.sparkContext.addPyFile(module.__file__)
            loaded.append(name)
        except Exception:  # an extension may fail in any way; the engine goes on without it
            logging.getLogger(__name__).exception("extension %s did not load", name)
    return loaded


register_defaults()
