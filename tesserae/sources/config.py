"""Configuration: typed sections, strict JSON source, atomic JSON sink, overrides, comparison."""

from __future__ import annotations

import argparse
import json
import os
import uuid
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.buckets import DEFAULT

# Sections, fields and their defaults, as configuration files have them.


@dataclass(frozen=True)
class Model:
    in_channels: int = 3
    base_channels: int = 128
    channel_mults: tuple = (1, 1, 2, 2, 4)
    latent_channels: int = 256
    num_res_blocks: int = 2
    codebook_size: int = 16384
    codebook_dim: int = 256
    commitment_beta: float = 0.15
    use_ema: bool = False
    ema_decay: float = 0.99
    dead_code_revival: bool = False
    codebook_init: str = "uniform"
    discriminator_channels: int = 64
    discriminator_num_layers: int = 3

    def __post_init__(self):
        object.__setattr__(self, "channel_mults", tuple(self.channel_mults))


@dataclass(frozen=True)
class Loss:
    lambda_perceptual: float = 1.0
    lambda_adv: float = 0.1
    adv_loss_type: str = "hinge"
    discriminator_start_step: int = 30000


@dataclass(frozen=True)
class Data:
    train_dir: str = "data/train"
    val_dir: str = "data/val"
    buckets: list = field(default_factory=lambda: [{"name": n, "width": w, "height": h} for n, w, h in DEFAULT])
    horizontal_flip: bool = True
    num_workers: int = 8


@dataclass(frozen=True)
class Train:
    output_dir: str = "runs/train"
    target_epochs: int = 30
    total_steps: int = 0
    batch_size: int = 2
    accumulation_steps: int = 8
    lr_generator: float = 4.5e-6
    lr_discriminator: float = 4.5e-6
    beta1: float = 0.5
    beta2: float = 0.9
    lr_warmup_steps: int = 1500
    mixed_precision: bool = True
    grad_checkpointing: bool = True
    log_every: int = 50
    image_log_every: int = 500
    checkpoint_every: int = 2000
    val_every: int = 2000
    keep_last_n_checkpoints: int = 5
    checkpoint_milestone_every: int = 10000
    dead_code_revival_every: int = 400
    kmeans_init_batches: int = 100
    kmeans_init_iters: int = 15
    num_workers: int = 8
    seed: int = 42
    resume_from: str = ""


SECTIONS = {"model": Model, "loss": Loss, "data": Data, "train": Train}

# Model fields that must not change on resume.
CRITICAL = (
    "in_channels", "base_channels", "channel_mults", "latent_channels", "num_res_blocks", "codebook_size", "codebook_dim",
    "discriminator_channels", "discriminator_num_layers", "use_ema",
)


# Command-line flags that set a value. Each sets the field of its name in all sections that have one.
VALUE_FLAGS = (
    "train-dir", "val-dir", "output-dir", "target-epochs", "batch-size", "accumulation-steps", "lr-generator", "lr-discriminator", "num-workers", "seed", "resume-from",
    "codebook-size", "discriminator-start-step", "lambda-perceptual", "lambda-adv", "commitment-beta", "dead-code-revival-every", "codebook-init", "kmeans-init-batches",
    "kmeans-init-iters", "lr-warmup-steps", "log-every", "image-log-every", "checkpoint-every", "val-every",
)
CHOICES = {"codebook-init": ("uniform", "kmeans")}

# Flags without a value, the field of each and what it becomes. None turns its field back.
SWITCHES = {"use-ema": ("use_ema", True), "dead-code-revival": ("dead_code_revival", True), "no-mixed-precision": ("mixed_precision", False), "no-grad-checkpointing": ("grad_checkpointing", False)}


def _checked(section: str, kind: type, values: dict) -> dict:
    """values, if each is of the type of its field's default; whole numbers also pass for fractions."""
    for f in fields(kind):
        if f.name in values:
            default = getattr(kind(), f.name)
            wanted = {float: (int, float), tuple: (list, tuple), list: (list, tuple)}.get(type(default), type(default))
            if not isinstance(v := values[f.name], wanted) or isinstance(v, bool) is not isinstance(default, bool):
                raise TypeError(f"{section}.{f.name} is {v!r}, but should be of type {type(default).__name__}")
    return values


@dataclass(frozen=True)
class Config:
    model: Model = field(default_factory=Model)
    loss: Loss = field(default_factory=Loss)
    data: Data = field(default_factory=Data)
    train: Train = field(default_factory=Train)

    @classmethod
    def parse(cls, tree: dict) -> Config:
        """Missing keys take defaults; an unknown key of a section, or a value of another type, raises TypeError."""
        return cls(**{name: kind(**_checked(name, kind, tree.get(name, {}))) for name, kind in SECTIONS.items()})

    def tree(self) -> dict:
        return asdict(self)


def load(path: str | None = None, default: str | None = None) -> Config:
    """The file, else the default file if it exists, else the defaults."""
    if path or (default and os.path.exists(default)):
        return Config.parse(json.loads(Path(path or default).read_text(encoding="utf-8")))
    return Config()


def write_whole(path: str, text: str) -> None:
    """Puts text at path so that readers, and a crash, find either the old file or the new one: a file of its own beside it, on disk before it takes the name."""
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    new = p.with_name(f".{p.name}.{uuid.uuid4().hex}")
    try:
        with open(new, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(new, p)
    finally:
        new.unlink(missing_ok=True)


def save(config: Config, path: str) -> None:
    write_whole(path, json.dumps(config.tree(), indent=2))


def sync(config: Config, path: str) -> bool:
    """Saves if the file differs; where to resume from is not kept. True if it was written."""
    bare = lambda c: replace(c, train=replace(c.train, resume_from=""))
    if os.path.exists(path) and json.dumps(bare(load(path)).tree()) == json.dumps(bare(config).tree()):
        return False
    save(bare(config), path)
    return True


def check_resume(stored: dict, config: Config) -> None:
    """Raises if a critical field of a checkpoint's config tree differs."""
    old, new = stored.get("model", {}), config.tree()["model"]
    plain = lambda v: tuple(v) if isinstance(v, list) else v
    bad = [f"{k}: {old.get(k)!r} in the checkpoint, {new[k]!r} now" for k in CRITICAL if plain(old.get(k)) != plain(new[k])]
    if bad:
        raise RuntimeError("the checkpoint does not fit this configuration: " + "; ".join(bad))


def key_values(config: Config) -> list[tuple[str, str]]:
    """section.field and its value as JSON."""
    return [(f"{s}.{k}", json.dumps(v)) for s, fields in config.tree().items() for k, v in fields.items()]


def overlay(base: DataFrame, overrides: DataFrame) -> DataFrame:
    """key, value: an override that isn't null wins."""
    o = overrides.select("key", F.col("value").alias("__new"))
    return base.join(o, "key", "left").select("key", F.coalesce("__new", "value").alias("value"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """key, left_value, right_value where they differ, null-safe, keys of either side."""
    d = a.select("key", F.col("value").alias("left_value")).join(b.select("key", F.col("value").alias("right_value")), "key", "full")
    return d.where(~F.col("left_value").eqNullSafe(F.col("right_value")))


def cli_override(config: Config, flags: dict[str, object]) -> Config:
    """section.field -> value, applied where it isn't None."""
    for key, v in flags.items():
        if v is not None:
            s, k = key.split(".")
            config = replace(config, **{s: replace(getattr(config, s), **{k: v})})
    return config


def _places(name: str) -> list[str]:
    return [f"{s}.{name}" for s, kind in SECTIONS.items() if name in kind.__dataclass_fields__]


def command_line(argv: list[str], default: str | None = None) -> tuple[Config, bool, str | None]:
    """The configuration of --config (else of default) under the flags that are given, whether to start afresh, and the file's path."""
    p = argparse.ArgumentParser(argument_default=argparse.SUPPRESS, allow_abbrev=False)
    p.add_argument("--config", default=None)
    p.add_argument("--fresh", action="store_true", default=False)
    plain = Config().tree()
    for flag in VALUE_FLAGS:
        section, name = _places(flag.replace("-", "_"))[0].split(".")
        p.add_argument(f"--{flag}", type=type(plain[section][name]), choices=CHOICES.get(flag))
    for flag, (name, value) in SWITCHES.items():
        p.add_argument(f"--{flag}", dest=name, action="store_const", const=value)
    given = vars(p.parse_args(argv))
    path, fresh = given.pop("config"), given.pop("fresh")
    return cli_override(load(path, default), {place: v for name, v in given.items() for place in _places(name)}), fresh, path or default


def _spark_type(value) -> T.DataType:
    if isinstance(value, dict):
        return T.StructType([T.StructField(k, _spark_type(v)) for k, v in value.items()])
    if isinstance(value, list | tuple):
        return T.ArrayType(_spark_type(value[0]))
    return {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}[type(value)]


def schema() -> T.StructType:
    """A configuration tree as a Spark type, for from_json."""
    return _spark_type(Config().tree())


def ranks(env=os.environ) -> tuple[int, int, int]:
    """(local rank, rank, world size) of a launcher's environment; a single process without one."""
    return int(env.get("LOCAL_RANK", "0")), int(env.get("RANK", "0")), int(env.get("WORLD_SIZE", "1"))
