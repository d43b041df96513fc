"""Prompts and result rows of multiple-choice benchmarks, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.functions import text as T

#: The instructions that the benchmarks give.
SELECT = "Please select the correct answer from the options above. \n"
VIDEO = "Select the best answer to the following multiple-choice question based on the video. Respond with only the letter (A, B, C, or D) of the correct option."
SUBTITLES = "This video's subtitles are listed below:\n"
OTHER = "Other Answers"
OPTIONS = "There are several options: \n"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def choices(columns: list[str]) -> Column:
    """The option columns that a table has and a row fills, as a map from letter to text."""
    there = [c for c in LETTERS if c in columns]
    pairs = F.map_from_arrays(F.array(*map(F.lit, there)), F.array(*(F.col(c).cast("string") for c in there)))
    return F.map_filter(pairs, lambda k, v: v.isNotNull() & (v != "NaN"))


def closed(rows: DataFrame) -> DataFrame:
    """Open questions as a choice of two: the answer, and any other."""
    open_ = F.col("A").isNull()
    return rows.withColumns({"B": F.when(open_, OTHER).otherwise(F.col("B")), "A": F.when(open_, F.col("answer")).otherwise(F.col("A"))})


def option_lines(options: Column, head: str = OPTIONS) -> Column:
    keys = F.array_sort(F.map_keys(options))
    return F.concat(F.lit(head), F.array_join(F.transform(keys, lambda k: F.concat(k, F.lit(". "), F.element_at(options, k), F.lit("\n"))), ""))


def question_prompt(question: Column, options: Column, hint: Column | None = None, trimmed: bool = True) -> Column:
    """Hint, question, options and the instruction (where there are options)."""
    before = F.coalesce(F.concat(F.lit("Hint: "), hint, F.lit("\n")), F.lit("")) if hint is not None else F.lit("")
    listed = F.when(F.size(options) > 0, F.concat(option_lines(options, "Options:\n"), F.lit(SELECT))).otherwise("")
    whole = F.concat(before, F.lit("Question: "), question, F.lit("\n"), listed)
    return F.regexp_replace(whole, r"\s+$", "") if trimmed else whole


def video_prompt(question: Column, options: Column, subtitles: Column | None = None) -> Column:
    """Subtitles where there are some, the instruction, the question and its option lines."""
    shown = F.when(F.coalesce(subtitles, F.lit("")) != "", F.concat(F.lit(SUBTITLES), subtitles, F.lit("\n"))).otherwise("") if subtitles is not None else F.lit("")
    return F.concat(shown, F.lit(VIDEO), F.lit("\nQuestion: "), question, F.lit("\n"), F.array_join(options, "\n"), F.lit("\nThe best answer is:"))


def answer_number(answer: Column) -> Column:
    """0 for A to 4 for E; anything else fails the job."""
    return F.when(answer.isin("A", "B", "C", "D", "E"), F.ascii(answer) - 65).otherwise(F.raise_error(F.concat(F.lit("not an option: "), F.coalesce(answer, F.lit("null")))))


def scored(rows: DataFrame, options: Column, seed: int = 0) -> DataFrame:
    """Add extracted_answer, extraction_method (rule or random), extraction_success and hit.

    Where the rules find nothing, an option is drawn by a hash of the row's index, in place of a judge.
    """
    found = T.infer_option(F.col("prediction"), F.col("_o"))
    keys = F.array_union(F.array_sort(F.map_keys("_o")), F.array(F.lit("Z")))
    drawn = F.element_at(keys, (F.pmod(F.xxhash64(F.lit(seed), F.col("index").cast("string")), F.size(keys)) + 1).cast("int"))
    out = rows.withColumn("_o", options).withColumn("_f", found)
    return out.withColumns(
        {
            "extracted_answer": F.coalesce("_f", drawn),
            "extraction_method": F.when(F.col("_f").isNotNull(), "rule").otherwise("random"),
            "extraction_success": F.coalesce(F.col("_f") != "Z", F.lit(False)),
        }
    ).withColumn("hit", (F.col("extracted_answer").eqNullSafe(F.col("answer"))).cast("int")).drop("_o", "_f")


#: What the planner and the status estimator of a robot are told, and how views and states are named.
PLANNER = (
    "You are a robot task planner. Given the global task, the completed subtasks, and {}, plan the remaining subtasks from the current state. "
    "Output a JSON array with only subtask_index and subtask_goal."
)
ESTIMATOR = (
    "You are a robot execution status estimator. Given the global task, the completed subtasks, the current subtask, the robot state values, and {}, predict the requested status values "
    "using the query tokens. Do not generate a natural-language answer."
)
VIEW_NAMES = {"main": "<main>", "left_wrist": "<left wrist>", "right_wrist": "<right wrist>"}
STATE = "Robot state: the gripper values of left and right arms are currently %.3f and %.3f, while the z values of left and right arms are %.3f and %.3f, respectively.\n"


def robot_parts(goal: Column, completed: Column, frames: Column, views: list[str], current: Column | None = None, state: Column | None = None, queries: list[str] | None = None) -> Column:
    """The user's content parts: task, what is done, the span and state at hand, the views of each frame (oldest first), and query tokens.

    ``completed``: an array of (subtask_index, subtask_goal); an image's value is ``<view>@<frame>``; ``state``: the two grippers and heights. A null state says nothing.
    """
    part = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("value"))
    said = lambda *texts: part("text", F.concat(*texts))
    head = [said(F.lit("Global task: "), goal, F.lit("\nCompleted subtasks: "), F.to_json(completed), F.lit("\n"))]
    if current is not None:
        head.append(said(F.lit("Current subtask: "), current, F.lit("\n")))
    if state is not None:
        head.append(part("text", F.when(state.isNotNull(), F.format_string(STATE, *(state[c] for c in ("left_grip", "right_grip", "left_z", "right_z"))))))
    label, many = "Image observation" if len(views) == 1 else "Image observations", F.size(frames) > 1
    head.append(part("text", F.when(many, F.lit(f"Historical {label.lower()} (oldest to newest):\n")).otherwise(F.lit(f"{label}:\n"))))

    def seen(frame: Column, k: Column) -> Column:
        time = part("text", F.when(many, F.format_string("<time %d frame %d>\n", (k + 1).cast("int"), frame.cast("int"))))
        return F.array(time, *(p for v in views for p in (part("text", F.lit(VIEW_NAMES[v] + " ")), part("image", F.concat(F.lit(v + "@"), frame.cast("string"))), part("text", F.lit("\n")))))

    tail = F.array(part("text", F.lit("".join(queries)))) if queries else F.array().cast("array<struct<type:string,value:string>>")
    return F.filter(F.concat(F.array(*head), F.flatten(F.transform(frames, seen)), tail), lambda p: p["value"].isNotNull())


def robot_system(views: list[str], plan: bool) -> str:
    return (PLANNER if plan else ESTIMATOR).format("image observation" if len(views) == 1 else "multi-view image observations")


def robot_prompt(rows: DataFrame, views: list[str], queries: list[str]) -> DataFrame:
    """Samples with ``system``, ``parts`` and ``answer``: plans answer with the goals ahead, status frames with query tokens alone (a null answer).

    Columns kind (plan or frame), goal, goals (array), idx, plan_start, frames (array) and state; a plan begins at plan_start, a status at idx.
    """
    plan = F.col("kind") == "plan"
    at = F.when(plan, F.col("plan_start")).otherwise(F.col("idx")).cast("int")
    numbered = F.transform("goals", lambda g, k: F.struct(k.alias("subtask_index"), g.alias("subtask_goal")))
    done, ahead = F.slice(numbered, 1, at), F.slice(numbered, at + 1, F.greatest(F.lit(0), F.size("goals") - at))
    of_plan = robot_parts(F.col("goal"), done, F.col("frames"), views)
    of_status = robot_parts(F.col("goal"), done, F.col("frames"), views, F.get("goals", at), F.col("state"), queries)
    return rows.withColumns({"system": F.when(plan, robot_system(views, True)).otherwise(robot_system(views, False)), "parts": F.when(plan, of_plan).otherwise(of_status), "answer": F.when(plan, F.to_json(ahead))})
