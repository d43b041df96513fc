"""Configurations: sections merged to a context, values expanded, and command-line arguments from them."""

from __future__ import annotations

import ast
import os
from pathlib import Path

#: The sections whose values other values can name, and how settings of training are called in evaluation.
SECTIONS = ("model", "data", "training")
RENAMED = {("model", "model_name_or_path"): "base_model"}
#: Settings of the data that evaluation takes without the prefix that names the data set (up to the first underscore).
UNPREFIXED = ("data_root", "anno_root", "anno_dir", "views", "memory_frames", "memory_frame_stride", "test_ratio", "q2_frame_stride", "boundary_extra_frames")
TRAINING = ("model_max_length", "voting_done", "done_vote_count")
BUCKET, IF_THERE = "q2_progress_bucket_size", "_if_exists"


def sections(config: dict) -> dict:
    """All values of the sections, later ones over earlier ones; raises if one is no object."""
    out: dict = {}
    for name in SECTIONS:
        values = config.get(name, {})
        if not isinstance(values, dict):
            raise ValueError(f"section {name!r} is no object")
        out |= values
    return out


def expanded(value, context: dict):
    """A text with the environment's variables and the context's values put in; one that names something unknown stays."""
    if not isinstance(value, str):
        return value
    text = os.path.expandvars(value)
    try:
        return text.format(**context)
    except KeyError:
        return text


def training_arguments(config: dict) -> list[str]:
    """``--key value`` for each value that is not null; a key that ends in ``_if_exists`` counts only where its path is there."""
    context, out = sections(config), []
    for name in SECTIONS:
        for key, raw in config.get(name, {}).items():
            value = expanded(raw, context)
            if value is None or (key.endswith(IF_THERE) and not Path(str(value)).expanduser().exists()):
                continue
            out += [f"--{key.removesuffix(IF_THERE)}", str(value)]
    return out


def evaluation_values(config: dict, task: str) -> dict:
    """The values that an evaluation takes: from training by other names, then the evaluation's own, those of q2 for its kin, and the task's."""
    context = sections(config)
    held = lambda section: config.get(section) or {}
    out = {name: held(section)[key] for (section, key), name in RENAMED.items() if key in held(section)}
    wanted = (*UNPREFIXED, BUCKET) if task.startswith("q2") else UNPREFIXED
    out |= {bare: value for key, value in held("data").items() if (bare := key.partition("_")[2]) in wanted}
    out |= {key: held("training")[key] for key in TRAINING if key in held("training")}
    own = config.get("eval", {})
    own = own if isinstance(own, dict) else {}
    out |= {k: v for k, v in own.items() if k not in ("q1", "q2") and not isinstance(v, dict)}
    for part in (["q2"] if task in ("q2_vis", "q2_bench") else []) + [task]:
        out |= own[part] if isinstance(own.get(part), dict) else {}
    return {k: expanded(v, context) for k, v in out.items()}


def with_defaults(given: dict, metadata: dict, defaults: dict) -> dict:
    """What was given, else what a run's metadata tells, else the default."""
    first = lambda k: next((x[k] for x in (given, metadata, defaults) if x.get(k) is not None), None)
    return {k: first(k) for k in {**defaults, **metadata, **given}}


def detection_sets(text: str) -> dict[str, dict]:
    """The data sets of a detection configuration, by name. It is a Python file of assignments; its literals are read, and nothing of it is run."""
    found: dict = {}

    def value(node):
        if isinstance(node, ast.Name) and node.id in found:
            return found[node.id]
        if isinstance(node, ast.Call) and getattr(node.func, "id", "") == "dict":
            return {k.arg: value(k.value) for k in node.keywords}
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
            return value(node.left) + value(node.right)
        if isinstance(node, ast.List | ast.Tuple):
            return [value(x) for x in node.elts]
        if isinstance(node, ast.Dict):
            return {value(k): value(v) for k, v in zip(node.keys, node.values)}
        return ast.literal_eval(node)

    for line in ast.parse(text).body:
        if isinstance(line, ast.Assign) and len(line.targets) == 1 and isinstance(line.targets[0], ast.Name):
            try:
                found[line.targets[0].id] = value(line.value)
            except (ValueError, TypeError):
                continue
    return dict(zip(found.get("dataset_prefixes", []), found.get("datasets", [])))
