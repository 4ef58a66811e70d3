"""Driver-side files on any file system Spark can reach: atomic publishing, JSON, waiting, model folders."""

from __future__ import annotations

import fnmatch
import json
import time
import uuid
from pathlib import PurePosixPath

from pyspark.sql import SparkSession

#: The files a model folder shares, and what never leaves it.
SHARED_FILES = ["model.pth", "model_config.json", "tokenizer.json", "tokenizer_config.json", "special_tokens_map.json", "added_tokens.json"]
PRIVATE_PATTERNS = ["*.py", "checkpoints/*", "metrics/*", "validation-cache-*"]
#: Config keys that older runs wrote and newer ones leave out.
OBSOLETE_KEYS = ["midtraining_epochs", "midtraining_completed_epochs"]
#: Fixed value: the version of the chat template that a chat model's config names.
CHAT_TEMPLATE_VERSION = 1


def file_system(spark: SparkSession, path: str):  # noqa: ANN201
    """(file system, Hadoop path)"""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder where all executors can write: next to the checkpoints, or in the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def publish(spark: SparkSession, draft: str, path: str) -> None:
    """Put a finished draft in a path's place. What stood there goes only once the draft stands; a failure puts it back."""
    fs, target = file_system(spark, path)
    source, aside = file_system(spark, draft)[1], file_system(spark, f"{path}.old-{uuid.uuid4().hex}")[1]
    if not fs.exists(source):
        raise FileNotFoundError(draft)
    had = fs.exists(target)
    if had and not fs.rename(target, aside):
        raise OSError(f"could not set {path} aside")
    done = False
    try:
        done = fs.rename(source, target)
        if not done:
            raise OSError(f"could not publish {path}")
    finally:
        if had and not done:
            fs.rename(aside, target)
    if had:
        fs.delete(aside, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A single UTF-8 file, whole or not at all."""
    draft = f"{path}.draft-{uuid.uuid4().hex}"
    fs, p = file_system(spark, draft)
    try:
        out = fs.create(p, True)
        try:
            out.write(bytearray(text.encode()))
            out.hsync()
        finally:
            out.close()
        publish(spark, draft, path)
    finally:
        fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    source = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
    finally:
        source.close()


def write_json(spark: SparkSession, path: str, value: dict, indent: int | None = None) -> None:
    write_text(spark, path, json.dumps(value, ensure_ascii=False, indent=indent) + "\n")


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(read_text(spark, path))


def wait_for(spark: SparkSession, path: str, timeout: float = 3600.0, every: float = 1.0) -> str:
    """Wait until a path exists, as when another job writes it."""
    end = time.monotonic() + timeout
    while not exists(spark, path):
        if time.monotonic() >= end:
            raise TimeoutError(f"{path} did not appear within {timeout} s")
        time.sleep(every)
    return path


def model_dir(spark: SparkSession, source: str) -> str:
    """A model folder by path. There is no hub to fetch from: a path that does not exist is refused."""
    if not exists(spark, source):
        raise FileNotFoundError(f"no model folder {source}")
    return source.rstrip("/")


def model_config(spark: SparkSession, source: str, **changes: object) -> dict:
    """A folder's config, with values that are given (not None) in place of the stored ones."""
    stored = read_json(spark, f"{model_dir(spark, source)}/model_config.json")
    return stored | {k: v for k, v in changes.items() if v is not None}


def write_model_config(spark: SparkSession, folder: str, config: dict, inherited: dict | None = None) -> dict:
    """A run's config over the one it inherits; obsolete keys are left out."""
    full = {k: v for k, v in ((inherited or {}) | config).items() if k not in OBSOLETE_KEYS}
    write_json(spark, f"{folder}/model_config.json", full)
    return full


#: What a chat model's config takes of its run, and the names it has beside them.
CHAT_SETTINGS = ("learning_rate", "base_model_id", "repeat_epochs", "posttraining_steps")


def chat_config(base: dict, run: dict, special: dict[str, int], train: list[str], validation: str) -> dict:
    """The config of a chat model: the base model's, the run's settings and where its data came from."""
    batch = run.get("batch_size", 1)
    settings = {k: run[k] for k in CHAT_SETTINGS}
    defaults = {"devices": "auto", "device_count": 1, "global_batch_size": batch, "global_effective_batch_size": batch}
    ids = {f"{name}_token_id": special[name] for name in ("pad", "bos", "eos", "end_of_turn")}
    data = {"trainable_layers": "all", "chat_template_version": CHAT_TEMPLATE_VERSION, "posttraining_datasets": train, "validation_dataset": validation}
    return base | {"training_max_len": run["max_len"]} | settings | {k: run.get(k, v) for k, v in defaults.items()} | ids | data


def publishable(files: list[str]) -> list[str]:
    """Which of a folder's files (relative paths) may be shared."""
    private = lambda f: any(fnmatch.fnmatch(f, p) or fnmatch.fnmatch(PurePosixPath(f).name, p) for p in PRIVATE_PATTERNS)
    return [f for f in files if f in SHARED_FILES and not private(f)]

