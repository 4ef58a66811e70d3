"""Settings of runs and the conditions they must meet, checked before any data is read."""

from __future__ import annotations

from collections.abc import Callable

Check = tuple[str, Callable[[dict], bool]]


def require(fine: bool, message: str) -> None:
    if not fine:
        raise ValueError(message)


def positive(text: str | float) -> float:
    value = float(text)
    require(value > 0, f"{text} must be positive")
    return value


def probability(text: str | float) -> float:
    value = float(text)
    require(0 < value <= 1, f"{text} must be in (0, 1]")
    return value


def count(text: str | int) -> int:
    value = int(text)
    require(value >= 0, f"{text} must not be negative")
    return value


def above(name: str, least: float = 0) -> Check:
    return f"{name} must be greater than {least}", lambda s: s[name] > least


#: The names and bounds of settings. What training runs have in common, whatever they train on.
RUN: list[Check] = [
    *(above(name) for name in ("learning_rate", "batch_size", "gradient_accumulation_steps", "max_steps", "val_batches", "val_check_interval", "checkpoint_every_n_steps", "metric_log_every_n_steps", "loss_chunk_size")),
    ("num_workers must not be negative", lambda s: s["num_workers"] >= 0),
    above("val_split_modulo", 1),
    ("val_split_index must lie within val_split_modulo", lambda s: 0 <= s["val_split_index"] < s["val_split_modulo"]),
    ("lr_warmup_steps must lie within max_steps", lambda s: 0 <= s["lr_warmup_steps"] < s["max_steps"]),
    ("min_learning_rate_ratio must lie within [0, 1]", lambda s: 0 <= s["min_learning_rate_ratio"] <= 1),
]
PRETRAINING: list[Check] = [
    *(above(name) for name in ("max_len", "d_model", "num_layers", "num_heads", "d_ff")),
    ("d_model must be divisible by num_heads", lambda s: s["d_model"] % s["num_heads"] == 0),
    ("the dimension of a head must be even", lambda s: s["d_model"] // s["num_heads"] % 2 == 0),
    *RUN,
]
MIDTRAINING: list[Check] = [("max_len must be greater than 0", lambda s: s["max_len"] is None or s["max_len"] > 0), *RUN]
POSTTRAINING: list[Check] = [above("repeat_epochs")]
#: What may be given of a schedule: all of it or nothing.
SCHEDULE = ("lr_warmup_steps", "lr_total_steps", "min_learning_rate")
#: The number types a model can be read in; None keeps the stored one.
NUMBER_TYPES = {"auto": None, "float16": "float16", "bfloat16": "bfloat16", "float32": "float32"}


def failures(settings: dict, checks: list[Check]) -> list[str]:
    """Every condition that is not met, in order; a later one that can't be judged then is left out."""
    out = []
    for message, fine in checks:
        try:
            if not fine(settings):
                out.append(message)
        except ZeroDivisionError:
            pass
    return out


def validate(settings: dict, checks: list[Check]) -> dict:
    """The settings, if they meet all conditions; the first that is not met is raised."""
    wrong = failures(settings, checks)
    require(not wrong, wrong[0] if wrong else "")
    return settings


def schedule(**given: float | None) -> dict | None:
    """The schedule's settings, or None if none is given; some but not all are refused."""
    set_ = [name for name in SCHEDULE if given.get(name) is not None]
    require(len(set_) in (0, len(SCHEDULE)), "a schedule needs " + ", ".join(SCHEDULE))
    return {name: given[name] for name in SCHEDULE} if set_ else None


def sft_config(embedding: tuple[int, int], blocks: int, heads: int, gate: tuple[int, int], max_len: int, learning_rate: float, special: dict[str, int]) -> dict:
    """A model's config from the shapes of its parameters: embedding (ids, d_model), gate projection (d_ff, d_model)."""
    require(gate[1] == embedding[1], "the gate projection must take d_model values")
    shape = {"max_len": max_len, "d_model": embedding[1], "num_layers": blocks, "num_heads": heads, "d_ff": gate[0], "learning_rate": learning_rate}
    return shape | {f"{name}_token_id": special[name] for name in ("pad", "bos", "eos")}
