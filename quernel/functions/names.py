"""Names and paths of repositories, episodes and files as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernel.functions import text as T

#: Where things are in a repository of episodes, and what names mean.
VIEWS = {"main": "observation.images.cam_main", "left_wrist": "observation.images.cam_left_wrist", "right_wrist": "observation.images.cam_right_wrist"}
VIDEO_FOLDER, CHUNK = "videos_240x320_240x320", 1000
VIDEO_ENDINGS = (".mp4", ".avi", ".mkv", ".mov", ".wmv", ".flv", ".webm", ".mpeg")
KIT = "aloha-agilex"
STATUS_TOKENS = ("<current_query>", "<plan_query>", "<incident_query>", "<value_query>")


def safe_name(text: Column) -> Column:
    """Letters, digits and ``._-``; anything else becomes an underscore."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}._-]", "_")


def slug_of_annotation(repo: Column) -> Column:
    return T.task_slug(repo, f"-{KIT}_")


def slug_of_evaluation(repo: Column) -> Column:
    return T.task_slug(repo, "-aloha-")


def slug_of_export(repo: Column) -> Column:
    """What stands before the mark, else the whole name."""
    return F.substring_index(repo, "-aloha-", 1)


def task_folder(repo: Column) -> Column:
    """The kit's part of a repository's name, else what follows its first hyphen."""
    kit = F.regexp_extract(repo, f"{KIT}_(?:clean_50|randomized_500)$", 0)
    rest = F.when(F.contains(repo, F.lit("-")), F.substr(repo, F.locate("-", repo) + 1)).otherwise(repo)
    return F.when(kit != "", kit).otherwise(rest)


def raw_folder(repo: Column) -> Column:
    return F.when(repo.endswith(f"-{KIT}_randomized_500"), "demo_randomized").when(repo.endswith(f"-{KIT}_clean_50"), "demo_clean").otherwise(task_folder(repo))


def episode_chunk(episode: Column, size: Column | None = None) -> Column:
    return F.floor(episode / F.coalesce(F.lit(CHUNK) if size is None else size, F.lit(CHUNK))).cast("long")


def episode_path(repo: Column, episode: Column, size: Column | None = None) -> Column:
    return F.format_string("%s/data/chunk-%03d/episode_%06d.parquet", repo, episode_chunk(episode, size), episode)


def view_paths(folder: Column, episode: Column, view: Column, size: Column | None = None) -> Column:
    """Where an episode's frames of a view can be: the flat path, then the one by chunks."""
    place = F.element_at(F.create_map(*(F.lit(x) for pair in VIEWS.items() for x in pair)), view)
    flat = F.format_string("%s/%s/episode_%06d.hdf5", folder, place, episode)
    return F.array(flat, F.format_string(f"%s/{VIDEO_FOLDER}/chunk-%03d/%s/episode_%06d.hdf5", folder, episode_chunk(episode, size), place, episode))


def annotation_path(row_path: Column, folder: Column, episode: Column) -> Column:
    """The given path, else the one in the repository's folder."""
    return F.coalesce(row_path, F.format_string("%s/anno/episode_%06d.json", folder, episode))


def folder_above(path: Column, levels: int = 2) -> Column:
    return F.regexp_replace(path, f"(?:/[^/]+){{{levels}}}$", "")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def repo_of(repo: Column, folder: Column, path: Column) -> Column:
    """The repository's name from a row that has it, its folder or an annotation's path; raises without any."""
    found = F.coalesce(F.nullif(repo, F.lit("")), base_name(F.nullif(folder, F.lit(""))), base_name(folder_above(F.nullif(path, F.lit("")))))
    return F.coalesce(found, F.raise_error(F.lit("a row names no repository")).cast("string"))


def episode_of(path: Column) -> Column:
    """The number in ``episode_000012.json``; null for other names."""
    return F.regexp_extract(base_name(path), r"^episode_(\d+)\.", 1).try_cast("int")


def episode_key(path: Column, folder: Column, repo: Column, episode: Column) -> Column:
    """What tells an episode: its annotation's path, else its folder (or name) and number."""
    return F.coalesce(path, F.concat_ws("#", F.coalesce(folder, repo), F.coalesce(episode, F.lit(-1)).cast("string")))


def converted_path(path: Column) -> Column:
    """An episode's place in the converted copy of its repository."""
    return F.regexp_replace(path, "/data/(chunk-[^/]+/[^/]+)$", "/data-lerobot/$1")


def is_video(name: Column) -> Column:
    out = F.lit(False)
    for ending in VIDEO_ENDINGS:
        out = out | F.lower(name).endswith(ending)
    return out


def absolute(base: Column, file: Column) -> Column:
    """A path below a base, with ``.`` and ``..`` followed; an absolute one stays."""
    joined = F.when(file.startswith("/"), file).otherwise(F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), file))
    parts = F.filter(F.split(joined, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def run_stamp(when: Column) -> Column:
    return F.date_format(when, "yyyyMMdd_HHmmss")


def special_tokens(votes: int = 0) -> list[str]:
    """The status tokens, and one for each vote on the current span."""
    return [*STATUS_TOKENS, *(f"<current_query_{k}>" for k in range(votes))]


def windows(text: Column) -> Column:
    """Positive whole numbers of a comma list, each once, in order."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != ""), lambda p: p.cast("int")), lambda n: n > 0)))


def views(text: str) -> list[str]:
    """The views of a comma list; raises if there are none or one is unknown."""
    found = [v for part in text.split(",") if (v := part.strip())]
    if not found or set(found) - set(VIEWS):
        raise ValueError(f"no or unknown views in {text!r}")
    return found


def issue_summary(issue: Column) -> Column:
    """A line that tells an issue, with the types and rules of the spans on both sides of it."""
    side = lambda name: F.when(issue[name].isNull(), "none").otherwise(F.concat_ws("/", F.coalesce(issue[name]["subtask_type"], F.lit("?")), F.coalesce(issue[name]["truncation_rule"], F.lit("?"))))
    number = F.coalesce(issue["subtask_index"], F.lit(-1))
    shown = F.when(number >= 0, (number + 1).cast("string")).otherwise("?")
    return F.concat(F.lit("issue: "), F.coalesce(issue["rule"], F.lit("")), F.lit("  |  left "), side("left_subtask"), F.lit(" -> current "), side("current_subtask"), F.lit("  |  subtask "), shown, F.lit(" (index "), number.cast("string"), F.lit(")"))


def issue_file(issue: Column, sample: Column) -> Column:
    number = F.coalesce(issue["subtask_index"], F.lit(-1)).cast("int")
    repo, rule = T.file_name(F.coalesce(issue["repo"], F.lit("repo")), 60), T.file_name(F.coalesce(issue["rule"], F.lit("issue")), 40)
    return F.format_string("issue_%02d_%s_episode_%06d_subtask_%02d_idx%02d_%s_review.mp4", sample.cast("int"), repo, F.coalesce(issue["episode_index"], F.lit(-1)).cast("int"), F.when(number >= 0, number + 1).otherwise(number), number, rule)
