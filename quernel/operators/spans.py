"""Spans of an episode from its steps, gripper events and motion: the fine and the coarse way.

Where a span ends decides where the next one looks, and taken events are gone, so an episode is walked in order, as one row of a
task's batches; an episode has a bounded number of frames. All searches inside of it (runs of motion, of rest, of
rising) are sums over whole arrays. Many episodes are many groups: nothing larger than one episode meets in a task.

Inputs by episode: ``frames`` (ep, f, state), ``events`` (ep, arm, kind, frame, start_frame, end_frame) and ``steps`` (ep, pos, text, kind,
arm, ends). Output: (ep, idx, goal, subtask_type, start, end, source, rule, gap_fill).
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable
from functools import lru_cache
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quernel.functions import goals as G
from quernel.operators import trajectory
from quernel.operators.series import plain

#: Least steps of motion (by what is searched), of turns and of rising, lengths of runs, margins and paths.
GRIP_MOVES, OTHER_MOVES, TURNS, RISES = 0.0005, 0.002, 0.01, 0.0005
RUN, RISING_RUN, PROTECTED, MARGIN, PAIR_GAP = 3, 2, 3, 4, 3
LEAST_OTHER_PATH, OTHER_SHARE, TINY_PATH = 0.05, 0.55, 0.01
#: Kinds of steps by their action, and the flags that end an action unless its step tells others.
KINDS = {
    "move": ("move", "move_to_close", "move_to_open", "move_to_open_late", "move_to_both_full_close", "midpoint", "handover_lift", "handover_retreat", "move_until_next_motion", "eef_lift", "eef_retreat", "eef_shake", "eef_shake_xy", "press_lift"),
    "close": ("close", "close_until_motion", "handover_close_until_release", "both_partial_close", "both_full_close"),
    "open": ("open", "handover_release_open"),
    "press": ("press", "press_down"),
    "handover": ("handover",),
}
ENDS = {
    "move": ("gripper_open", "gripper_close", "other_arm_motion"),
    "open": ("gripper_open", "gripper_close", "current_arm_motion", "other_arm_motion"),
    "close": ("gripper_open", "gripper_close", "current_arm_motion", "other_arm_motion"),
    "press": ("gripper_open", "gripper_close", "other_arm_motion"),
    "handover": ("handover_release", "gripper_open"),
}
#: Tasks whose first placing is done by both arms, with the least path of the arm aside.
ASIDE = {"place_dual_shoes": 0.015, "place_cans_plasticbox": 0.02}
RETREAT = r"(?i)\b(?:lift|return|retract)\b(?:.+\bafter (?:releasing|pressing)\b|.+above the table\b)"
SPAN = "ep {}, idx int, goal string, subtask_type string, start long, end long, source string, rule string, gap_fill string"
#: Fixed value: episodes that a task has as Python objects at one time.
EPISODES = 256
STEP = "array<struct<text:string,kind:string,arm:string,ends:array<string>>>"


class Step(NamedTuple):
    text: str
    kind: str = "final"
    arm: str | None = None
    ends: tuple[str, ...] = ()


class Event(NamedTuple):
    frame: int
    arm: str
    kind: str
    start: int
    end: int


class Boundary(NamedTuple):
    frame: int
    source: str
    rule: str
    event: Event | None = None


def action_of(step: Step) -> str:
    return next((action for action, kinds in KINDS.items() if step.kind in kinds), "final")


# ---- Motion


class Motion:
    """What both arms do from frame to frame; the number at a frame is the step into it."""

    def __init__(self, states: np.ndarray | None):
        self.frames = 0 if states is None else len(states)
        self.path, self.turn, self.rise, self.height = {}, {}, {}, {}
        for arm, first in trajectory.ARMS.items() if self.frames else ():
            steps = np.diff(states[:, first : first + 7], axis=0, prepend=states[:1, first : first + 7])
            self.path[arm], self.turn[arm] = np.linalg.norm(steps[:, :3], axis=1), np.linalg.norm(steps[:, 3:], axis=1)
            self.rise[arm], self.height[arm] = steps[:, 2], states[:, first + 2]

    @staticmethod
    def first_run(on: np.ndarray, first: int, last: int, length: int) -> int | None:
        """The first frame from ``first`` on that begins ``length`` frames in a row, none after ``last``."""
        last = min(last, len(on) - 1)
        if last - first + 1 < length:
            return None
        sums = np.concatenate([[0], np.cumsum(on[first : last + 1])])
        found = np.flatnonzero(sums[length:] - sums[:-length] == length)
        return first + int(found[0]) if len(found) else None

    def window(self, first: int, last: int) -> tuple[int, int]:
        first = max(1, min(first, self.frames - 1))
        return first, max(first, min(last, self.frames - 1))

    def moves(self, arm: str | None, first: int, last: int, least: float = GRIP_MOVES, turns: float = TURNS, length: int = RUN) -> int | None:
        """Where an arm starts to move (or turn) for a while."""
        if arm not in self.path:
            return None
        return self.first_run((self.path[arm] > least) | (self.turn[arm] > turns), *self.window(first, last), length)

    def rises(self, arm: str | None, first: int, last: int) -> int | None:
        return self.first_run(self.rise[arm] > RISES, *self.window(first, last), RISING_RUN) if arm in self.rise else None

    def settles(self, first: int, last: int, least: float = OTHER_MOVES, length: int = RUN) -> int | None:
        """Where both arms come to rest for a while, after one has moved."""
        if self.frames < 2:
            return None
        first = max(0, min(first, self.frames - 2))
        last = max(first, min(last, self.frames - 2))
        left, right = self.path["left"][1:], self.path["right"][1:]
        busy = np.flatnonzero((left > least) | (right > least))
        busy = busy[busy >= first]
        begin = max(first, int(busy[0]) - length + 1) if len(busy) else None
        if begin is None or max(busy[0], first + length - 1) > last:
            return None
        return self.first_run((left < least) & (right < least), begin, last, length)

    def breaks(self, arm: str | None, first: int, last: int) -> int | None:
        """Where, after the first frames, one arm goes on while the other has stopped."""
        other = G.other_arm_of(arm)
        if arm not in self.path or other is None:
            return None
        first = max(1, min(first + PROTECTED, self.frames - 1))
        on = (self.path[arm] > OTHER_MOVES) & (self.path[other] <= OTHER_MOVES)
        return self.first_run(on, first, max(first, min(last, self.frames - 2)), RUN)

    def length(self, arm: str, first: int, last: int) -> float:
        return float(self.path[arm][first + 1 : last + 1].sum()) if arm in self.path and last > first else 0.0


# ---- Fine spans


def earliest(found: list[Boundary]) -> Boundary | None:
    return min(found, key=lambda b: b.frame, default=None)


def end_of_move(found: list[Boundary]) -> Boundary | None:
    """The first gripper event, unless motion comes well before it."""
    grip = earliest([b for b in found if b.event])
    motion = earliest([b for b in found if not b.event and (grip is None or b.frame + MARGIN < grip.frame)])
    return motion or grip


class Walk:
    """A walk over the steps of one episode. Events that a step has taken are not there for later ones."""

    def __init__(self, steps: list[Step], events: list[Event], frames: int, states: np.ndarray | None, by_arm: bool):
        self.steps, self.events, self.frames, self.by_arm = steps, events, frames, by_arm
        self.motion = Motion(states)
        self.taken: set[int] = set()
        self.end, self.last_arm = -1, None

    def take(self, kind: str, arm: str | None) -> Event | None:
        """The next free event of a kind, of the given arm if there is one."""
        free = [k for k, e in enumerate(self.events) if k not in self.taken and e.frame > self.end and e.kind == kind]
        wanted = [k for k in free if arm and self.by_arm and self.events[k].arm == arm] or free
        if not wanted:
            return None
        self.taken.add(wanted[0])
        return self.events[wanted[0]]

    def partners(self, lead: Event) -> list[Event]:
        """Free events of the other arm that do the same at about the same time; they are taken too."""
        found = [k for k, e in enumerate(self.events) if k not in self.taken and e.kind == lead.kind and e.arm != lead.arm and abs(e.frame - lead.frame) <= PAIR_GAP]
        self.taken.update(found)
        return [self.events[k] for k in found]

    def upcoming(self, after: int, kinds: Iterable[str], start: int) -> list[Boundary]:
        """Boundaries before later events of some kinds, taken or not."""
        return [Boundary(max(start, e.start) - 1, f"before_gripper_{e.arm}_{e.kind}", f"gripper_{e.kind}", e) for e in self.events if e.frame > after and e.kind in kinds]

    def moving(self, arms: Iterable[str | None], first: int, least: float, rule: str) -> list[Boundary]:
        starts = ((a, self.motion.moves(a, first, self.frames - 1, least)) for a in dict.fromkeys(arms))
        return [Boundary(f - 1, f"before_eef_{a}_motion", rule) for a, f in starts if f is not None]

    def next_arm(self, k: int) -> str | None:
        if k + 1 >= len(self.steps):
            return None
        named = G.arm_context_of(self.steps[k + 1].text)
        return named if named in G.ARMS else self.steps[k + 1].arm

    def boundary(self, k: int, start: int) -> tuple[Boundary | None, Event | None]:
        """Where a step ends, and the event that it is about."""
        step = self.steps[k]
        action, both = action_of(step), uses_both(step)
        named = G.arm_context_of(step.text)
        actor = None if both else named or (step.arm if step.arm in G.ARMS else self.last_arm)
        flags = set(step.ends or ENDS.get(action, ()))
        kinds = [kind for kind in ("open", "close") if f"gripper_{kind}" in flags]
        after = self.next_arm(k)
        if action in ("open", "close"):
            event = self.take(action, actor)
            if event is None:
                return None, None
            together = [event, *(self.partners(event) if actor is None or both else ())]
            until = max(e.end for e in together)
            found = self.upcoming(max(self.end, until), kinds, start)
            if "current_arm_motion" in flags:
                found += self.moving((e.arm for e in together), until + 1, GRIP_MOVES, "current_arm_motion")
            if "other_arm_motion" in flags:
                others = [G.other_arm_of(event.arm)] if len(together) == 1 else []
                found += self.moving([*others, after], until + 1, GRIP_MOVES, "other_arm_motion")
            return earliest(found), event
        if action == "move":
            found = self.upcoming(self.end, kinds, start)
            if "other_arm_motion" in flags and both and after:
                if (frame := self.motion.breaks(after, start, self.frames - 1)) is not None:
                    found.append(Boundary(frame - 1, f"before_eef_{after}_motion", "other_arm_motion"))
            elif "other_arm_motion" in flags and after != actor and not re.search(G.RETURNING, step.text):
                found += self.moving([after], start + 1, OTHER_MOVES, "other_arm_motion")
            if "both_arms_settle" in flags and (frame := self.motion.settles(start + 1, self.frames - 1)) is not None:
                found.append(Boundary(frame, "both_arms_settle", "both_arms_settle"))
            return end_of_move(found), None
        if action == "press":
            found = self.upcoming(self.end, kinds, start)
            if "other_arm_motion" in flags:
                found += self.moving([after if after != actor else None, G.other_arm_of(actor)], start + 1, OTHER_MOVES, "other_arm_motion")
            if "press_lift" in flags and (frame := self.motion.rises(actor, start + 1, self.frames - 1)) is not None:
                found.append(Boundary(frame - 1, f"before_eef_{actor}_z_increase", "press_lift"))
            return earliest(found), None
        if action == "handover":
            event = self.take("open", G.release_arm_of(step.text))
            since = event.end if event else self.end
            found = [b for b in self.upcoming(since, ("open",), start) if event is None or (b.event.arm, b.event.frame) != (event.arm, event.frame)]
            if "other_arm_motion" in flags:
                found += self.moving([G.other_arm_of(event.arm) if event else after], since + 1, OTHER_MOVES, "other_arm_motion")
            return earliest(found), event
        return None, None

    def spans(self) -> list[dict]:
        out: list[dict] = []
        for k, step in enumerate(self.steps):
            if self.end >= self.frames - 1:
                break
            start, last, action = self.end + 1, k == len(self.steps) - 1, action_of(step)
            found, event = self.boundary(k, start)
            source, rule = (found.source, found.rule) if found else ("episode_end", "episode_end")
            end = min(self.frames - 1, found.frame) if found else self.frames - 1
            if found and found.event and event is None and action != "move":
                event = found.event
            if end < start and not last:
                continue
            if last:
                end, rule = self.frames - 1, "episode_end"
                source = f"episode_end_after_{source}" if found else source
            out.append(
                {"goal": G.with_event_arm_of(step.text, event and event.arm), "subtask_type": f"dual_{action}" if uses_both(step) else action, "start": start, "end": end, "source": source, "rule": rule, "gap_fill": None}
            )
            named = G.arm_context_of(step.text) or step.arm
            if event:
                self.last_arm = event.arm
            elif named in G.ARMS:
                self.last_arm = named
            elif found and found.event:
                # what the next step is about
                self.last_arm = found.event.arm
            self.end = end
        return arms_named(retreats_merged(others_told(out, self.motion)))


def uses_both(step: Step) -> bool:
    return G.arm_context_of(step.text) == "both" or G.uses_both_of(step.text)


def others_told(spans: list[dict], motion: Motion) -> list[dict]:
    """Spans of one moving arm tell of the other one where its path is long too."""
    if not motion.frames:
        return spans
    for span in spans:
        low, source = span["goal"].lower(), span["source"]
        named, at = G.arm_context_of(span["goal"]), G.boundary_arm_of(source)
        arm = named or at
        at_grip = re.search("^(?:episode_end_after_)?(?:before_)?gripper_", source)
        to_grasp = re.search("^(?:episode_end_after_)?(?:before_)?gripper_(?:left|right)_close", source) and re.search(r"\bgrasp pose\b", low)
        at_other = re.search("^(?:episode_end_after_)?(?:before_)?eef_(?:left|right)_", source) and at not in (None, arm)
        told = re.search(r"\bwhile\b|both arms|dual arms|other arm|both grippers", low)
        moves = re.search(r"\b(?:move|lift|return|place|pull|scan|rotate|shake)\b", low)
        if arm not in G.ARMS or told or at_other or not moves or (at_grip and not to_grasp):
            continue
        other = G.other_arm_of(arm)
        mine, its = motion.length(arm, span["start"], span["end"]), motion.length(other, span["start"], span["end"])
        if its < LEAST_OTHER_PATH or its < OTHER_SHARE * mine:
            continue
        text = span["goal"] if named else G.with_arm_of(span["goal"], arm)
        phrase = f" while returning the {other} arm to a neutral pose" if re.search(r"\bgrasp pose\b", low) else f" while moving the {other} arm"
        span["goal"] = f"{text[:-1]}{phrase}." if text.endswith(".") else text + phrase
    return spans


def taken_in(before: dict, span: dict) -> None:
    """A span becomes the end of the one before it."""
    before |= {key: span[key] for key in ("end", "source", "rule")}


def retreats_merged(spans: list[dict]) -> list[dict]:
    """A retreat after a release belongs to the release."""
    out: list[dict] = []
    for span in spans:
        retreat = span["subtask_type"] == "move" and re.search(r"(?i)\b(?:retract|return|retreat|neutral pose|lift up|separate)\b", span["goal"])
        if out and retreat and out[-1]["subtask_type"] in ("open", "dual_open", "handover"):
            out[-1]["goal"] = G.joined_while_of(out[-1]["goal"], span["goal"])
            taken_in(out[-1], span)
        else:
            out.append(span)
    return out


def arms_named(spans: list[dict]) -> list[dict]:
    """Each goal names an arm: its own, that of its boundary, or that of the goal before it. A first and a receiving arm get their sides."""
    context, sides = None, {"first": None, "receiving": None}
    for span in spans:
        text, at = span["goal"], G.boundary_arm_of(span["source"])
        for role, side in sides.items():
            text = re.sub(rf"\b{role} arm\b", f"{side} arm", text) if side else text
        named = G.arm_context_of(text)
        arm = named or at or context
        if named is None and arm in G.ARMS:
            text, named = G.with_arm_of(text, arm), arm
        span["goal"], low = text, text.lower()
        if at:
            if sides["first"] is None and low.startswith(("pick up", "grasp")):
                sides["first"] = at
            elif sides["first"] not in (None, at) and low.startswith("grasp"):
                sides["receiving"] = at
        context = named or arm or context
    return spans


def tiny_retreat_merged(spans: list[dict], motion: Motion) -> list[dict]:
    """A tiny retreat of the same arm at the episode's end belongs to the gripper step before it."""
    if not motion.frames or len(spans) < 2:
        return spans
    before, last = spans[-2:]
    arm = G.arm_context_of(last["goal"])
    at_end = last["source"] == "episode_end" or last["source"].startswith("episode_end_after_")
    grips = before["subtask_type"] in ("open", "close", "dual_open", "dual_close") and last["subtask_type"] == "move"
    if not (grips and at_end and arm in G.ARMS and arm == G.arm_context_of(before["goal"]) and re.search(RETREAT, last["goal"]) and motion.length(arm, last["start"], last["end"]) < TINY_PATH):
        return spans
    return [*spans[:-2], before | {"end": last["end"], "source": "episode_end", "rule": "episode_end"}]


def switches_told(spans: list[dict], applies: bool) -> list[dict]:
    """After one arm's release and before the other's grasp, the goal tells that the first one returns."""
    for before, span in zip(spans, spans[1:]) if applies else ():
        released = re.fullmatch("(?:before_)?gripper_(left|right)_(?:strict_)?open", before["source"])
        picks = re.fullmatch("(?:before_)?gripper_(left|right)_(?:strict_)?close", span["source"])
        if not released or not picks or released[1] == picks[1] or re.search(r"(?i)\breturn\b.+\bneutral pose\b", span["goal"]):
            continue
        text = span["goal"].removesuffix(".")
        verbs = {"Grasp": "grasping", "Pick up": "picking up"}
        verb = next((v for v in verbs if re.match(rf"{v}\b", text)), None)
        clause = verbs[verb] + text[len(verb) :] if verb else G.lowered_of(text)
        span["goal"] = f"Return the {released[1]} arm to a neutral pose while {clause or f'the {picks[1]} arm grasps the next object'}."
    return spans


def first_place_of_both(spans: list[dict], motion: Motion, slug: str) -> list[dict]:
    """In some tasks the first move to a place pose is one of both arms, and tells of the arm aside if its path is long enough."""
    if slug not in ASIDE or not motion.frames:
        return spans
    span = next((s for s in spans if re.match("Move the (left|right) arm to the place pose", s["goal"])), None)
    arm = span and G.arm_context_of(span["goal"])
    if span is None or re.search(r"(?i)\bwhile (?:returning|moving)\b", span["goal"]) or arm not in G.ARMS:
        return spans
    span["subtask_type"] = "dual_move"
    if motion.length(G.other_arm_of(arm), span["start"], span["end"]) >= ASIDE[slug]:
        span["goal"] = f"{span['goal'].removesuffix('.')} while moving the {G.other_arm_of(arm)} arm aside."
    return spans


def fine_spans(steps: list[Step], events: list[Event], frames: int, states: np.ndarray | None = None, by_arm: bool = True) -> list[dict]:
    """The spans of one episode; raises if it has no frames. ``by_arm``: a step takes an event of its own arm first."""
    if frames <= 0:
        raise ValueError("an episode has no frames")
    return Walk(steps, events, frames, states, by_arm).spans()


# ---- Coarse spans


class Piece(NamedTuple):
    """A stretch of motion, or a group of gripper events: with a kind and a frame then."""

    start: int
    end: int
    arms: frozenset
    kind: str | None = None
    frame: int = 0


BOTH = frozenset(G.ARMS)


def goes_with(segment: frozenset, group: frozenset) -> bool:
    return bool(segment & group)


@lru_cache(4096)
def hint_of(step: Step) -> tuple[str, frozenset | None]:
    """The action of a step as a hint, and the arms that it names, if it does."""
    named = step.arm if step.arm in G.ARMS else G.arm_context_of(step.text)
    action = {"handover": "handover", "open_move": "open_move", "close": "grasp", "open": "place"}.get(step.kind, "move")
    return action, BOTH if uses_both(step) else frozenset([named]) if named in G.ARMS else None


class CoarseWalk:
    """A walk over the segments of motion of one episode, which end at gripper groups or where the arm changes.

    Groups stand in order of their starts. Each question about free groups is one about frames, so it looks at the groups around these alone.
    """

    def __init__(self, steps: list[Step], segments: list[Piece], groups: list[Piece], frames: int, heights: dict[str, np.ndarray], merge_text: bool):
        self.steps, self.segments, self.groups, self.frames, self.heights, self.merge_text = steps, segments, sorted(groups, key=lambda g: g.start), frames, heights, merge_text
        self.free = dict(enumerate(self.groups))
        self.starts, self.latest_ends = [g.start for g in self.groups], list(accumulate((g.end for g in self.groups), max))
        self.hint, self.emitted, self.last_kind = 0, -1, None
        self.out: list[dict] = []
        self.clear()

    def clear(self) -> None:
        self.start, self.end, self.arms, self.single = None, -1, frozenset(), None

    def among(self, first: int, last: int) -> Iterable[tuple[int, Piece]]:
        """The free groups of some places in order."""
        return ((k, self.free[k]) for k in range(first, last) if k in self.free)

    def fits(self, step: Step, kind: str, arms: frozenset) -> bool:
        """Whether a step's hint can be the goal of a span."""
        action, context = hint_of(step)
        if action == "handover" and kind.endswith("place"):
            return context is None or bool(context & arms)
        return action in kind and (context is None or context == arms)

    def goal(self, kind: str, arms: frozenset) -> tuple[str, str | None]:
        """The text of the hint that a span takes, and the hint's kind; a general text where a move has none."""
        ahead = range(self.hint, len(self.steps))
        if kind.endswith("move"):
            place = next((k for k in ahead[:1] if self.fits(self.steps[k], kind, arms)), None)
        else:
            place = next((k for k in ahead if self.fits(self.steps[k], kind, arms)), next(iter(ahead), None))
        if place is not None:
            self.hint = place + 1
            return self.steps[place].text, self.steps[place].kind
        who = "both arms" if len(arms) == 2 else f"the {next(iter(arms), 'active')} arm"
        if kind.endswith("grasp"):
            return f"Grasp the target with {who}.", None
        if kind.endswith("place"):
            return f"Place the target with {who}.", None
        return (f"Open and retreat {who}." if kind == "open_move" else f"Move {who}."), None

    def worded(self, text: str, arms: frozenset, at: int | None) -> str:
        """The goal with its one arm named and, at a frame, with the height that the arm has there."""
        if len(arms) != 1:
            return text
        (arm,) = arms
        if at is not None and text.lower().startswith("retract") and "above the table" in text and 0 <= at < len(self.heights.get(arm, ())):
            height = max(0, round((float(self.heights[arm][at]) - G.TABLE_HEIGHT) * 100))
            text = re.sub(r"(?i)\bto (?:at least|about) \d+ cm above the table\b", f"to about {height} cm above the table", text)
        return G.with_arm_of(text, arm)

    def add(self, goal: str, kind: str, start: int, end: int, source: str, rule: str) -> None:
        self.out.append({"goal": goal, "subtask_type": kind, "start": max(self.emitted + 1, start), "end": min(self.frames - 1, end), "source": source, "rule": rule, "gap_fill": None})
        self.emitted = self.out[-1]["end"]

    def emit(self, end: int, group: Piece | None, arms: frozenset) -> None:
        """The span since the start, up to a gripper group or a change of the arm."""
        arms = group.arms if group and len(group.arms) == 1 else arms or self.arms
        waiting = [k for k, g in self.among(bisect_right(self.starts, self.emitted), bisect_right(self.starts, self.start)) if arms & g.arms]
        start = min([self.start, *(self.free.pop(k).start for k in waiting)])
        what = "move" if group is None else "grasp" if group.kind == "close" else "place"
        kind = f"{'dual' if len(arms) == 2 else 'single'}_{what}"
        text, hint = self.goal(kind, arms)
        end = max(end, start)
        text = self.worded(text, arms, min(self.frames - 1, end))
        source, rule = (f"after_gripper_{'_'.join(sorted(group.arms))}_{group.kind}", f"gripper_{group.kind}") if group else ("single_arm_switch", "single_arm_switch")
        self.add(text, "handover" if hint == "handover" else kind, start, end, source, rule)
        self.last_kind = group.kind if group else None
        self.clear()

    def opens_first(self, segment: Piece, after: Piece | None) -> bool:
        """A span of its own for a waiting release of this arm, where the other arm joins next."""
        if self.start is not None or after is None or not after.arms - segment.arms or len(segment.arms) != 1:
            return False
        # all groups before the first of these have ended
        near = self.among(bisect_right(self.latest_ends, self.emitted), bisect_right(self.starts, segment.start))
        key = next((k for k, g in near if g.kind == "open" and g.end > self.emitted and g.arms == segment.arms), None)
        if key is None:
            return False
        group = self.free.pop(key)
        text, _ = self.goal("open_move", segment.arms)
        self.add(self.worded(text, segment.arms, None), "open_move", group.start, max(after.start - 1, group.end), "before_other_arm_motion", "other_arm_motion")
        return True

    def begin(self, segment: Piece, single: str | None) -> None:
        self.start, self.end, self.arms, self.single = segment.start, segment.end, segment.arms, single

    def spans(self) -> list[dict]:
        alone = lambda s: next(iter(s.arms)) if s and len(s.arms) == 1 else None
        for k, segment in enumerate(self.segments):
            after = self.segments[k + 1] if k + 1 < len(self.segments) else None
            if self.opens_first(segment, after):
                continue
            single, was = alone(segment), alone(self.segments[k - 1]) if k else None
            if self.start is None:
                self.begin(segment, single)
            elif single and was and single != was and self.single == was and self.last_kind != "open":
                self.emit(segment.start - 1, None, frozenset([was]))
                self.begin(segment, single)
            else:
                self.end, self.arms, self.single = segment.end, self.arms | segment.arms, self.single or single
            until = after.start if after else self.frames
            near = self.among(bisect_left(self.starts, self.start), bisect_left(self.starts, until))
            key = next((k for k, g in near if goes_with(self.arms, g.arms)), None)
            if key is not None:
                group = self.free.pop(key)
                self.emit(group.end, group, self.arms)
        if self.start is not None:
            self.emit(self.end, None, self.arms)
        return self.closed()

    def closed(self) -> list[dict]:
        """No gaps: the first span begins at 0, each reaches the next one; then spans that belong together are merged."""
        out = self.out
        if not out:
            self.add(self.steps[0].text if self.steps else "Complete the task.", "single_move", 0, self.frames - 1, "episode_end", "episode_end")
        if out[0]["start"] > 0:
            out[0] |= {"start": 0, "gap_fill": "extended_to_episode_start"}
        for span, after in zip(out, out[1:]):
            if span["end"] < after["start"] - 1:
                span |= {"end": after["start"] - 1, "gap_fill": "extended_to_next_subtask_start"}
        if out[-1]["rule"] == "single_arm_switch":
            out[-1] |= {"end": self.frames - 1, "source": "episode_end", "rule": "episode_end"}
        return releases_led(moves_after_release(followed(releases_led(out)), self.merge_text))


def releases_led(spans: list[dict]) -> list[dict]:
    """A release with a retreat just before a handover is its beginning."""
    out: list[dict] = []
    for span in spans:
        if out and out[-1]["subtask_type"] == "open_move" and span["subtask_type"] == "handover":
            lead = out.pop()
            text = lead["goal"].strip().rstrip(".")
            clause = G.concurrent_of(span["goal"])
            span |= {"start": lead["start"], "goal": span["goal"] if not text else f"{text} while {clause}." if clause else f"{text}."}
        out.append(span)
    return out


def followed(spans: list[dict]) -> list[dict]:
    """What comes just after a handover belongs to it: one span each time."""
    out: list[dict] = []
    closed = False
    for span in spans:
        if out and not closed and out[-1]["subtask_type"] == "handover" and span["subtask_type"] in ("single_place", "dual_place", "single_move", "dual_move", "open_move"):
            if span["subtask_type"] != "open_move":
                out[-1]["goal"] = G.joined_while_of(out[-1]["goal"], span["goal"])
            taken_in(out[-1], span)
            closed = True
        else:
            out.append(span)
            closed = False
    return out


def moves_after_release(spans: list[dict], merge_text: bool) -> list[dict]:
    """Moves after a release belong to it; their text is told unless both speak of the same one arm."""
    out: list[dict] = []
    for span in spans:
        if out and span["subtask_type"] in ("single_move", "dual_move", "open_move") and out[-1]["subtask_type"] in ("single_place", "dual_place", "open_move", "handover"):
            named = G.arm_context_of(out[-1]["goal"])
            if merge_text and not (named in G.ARMS and named == G.arm_context_of(span["goal"])):
                out[-1]["goal"] = G.joined_while_of(out[-1]["goal"], span["goal"])
            taken_in(out[-1], span)
        else:
            out.append(span)
    return out


def coarse_spans(steps: list[Step], segments: list[Piece], groups: list[Piece], frames: int, states: np.ndarray | None, merge_text: bool = True) -> list[dict]:
    """The spans of one episode from its cut segments and its gripper groups; raises if it has no frames."""
    if frames <= 0:
        raise ValueError("an episode has no frames")
    return CoarseWalk(steps, segments, groups, frames, {} if states is None else {arm: states[:, first + 2] for arm, first in trajectory.ARMS.items()}, merge_text).spans()


# ---- Tables


def told(steps: DataFrame) -> DataFrame:
    return steps.groupBy("ep").agg(F.array_sort(F.collect_list(F.struct("pos", "text", "kind", "arm", "ends"))).alias("steps"))


def packed(frames: DataFrame, events: DataFrame, steps: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """One row for each episode with frames: its states in order, its events and its steps."""
    states = frames.groupBy("ep").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "state"))), lambda x: x["state"]).alias("states"))
    taken = events.groupBy("ep").agg(F.array_sort(F.collect_list(F.struct("frame", "arm", "kind", F.coalesce("start_frame", "frame").cast("long").alias("start"), F.coalesce("end_frame", "frame").cast("long").alias("end")))).alias("events"))
    out = states.join(taken, "ep", "left").join(told(steps), "ep", "left")
    return out if extra is None else out.join(extra, "ep", "left")


def steps_in(row) -> list[Step]:
    return [Step(s["text"], s["kind"] or "final", s["arm"], tuple(() if s["ends"] is None else s["ends"])) for s in (row.steps if row.steps is not None else ())]


def events_in(row) -> list[Event]:
    return [Event(int(e["frame"]), e["arm"], e["kind"], int(e["start"]), int(e["end"])) for e in (row.events if row.events is not None else ())]


def rows_of(ep, spans: list[dict]) -> list[tuple]:
    return [(ep, k, s["goal"], s["subtask_type"], s["start"], s["end"], s["source"], s["rule"], s["gap_fill"]) for k, s in enumerate(spans)]


COLUMNS = ["ep", "idx", "goal", "subtask_type", "start", "end", "source", "rule", "gap_fill"]


def assign(frames: DataFrame, events: DataFrame, steps: DataFrame, slugs: DataFrame | None = None, by_arm: bool = True, retreat_tasks: tuple[str, ...] = (), in_time_order: tuple[str, ...] = ()) -> DataFrame:
    """The fine spans of all episodes with frames. ``slugs`` (ep, slug) adds the passes that depend on the task.

    In tasks ``in_time_order`` a step takes the next event whichever arm it is of; in ``retreat_tasks`` goals tell that an arm returns.
    """

    by_task = slugs is not None

    def walk(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                states = np.stack([np.asarray(s, float) for s in row.states])
                slug = (row.slug or "") if by_task else ""
                spans = fine_spans(steps_in(row), events_in(row), len(states), states, by_arm and slug not in in_time_order)
                if by_task:
                    motion = Motion(states)
                    spans = first_place_of_both(switches_told(tiny_retreat_merged(spans, motion), slug in retreat_tasks), motion, slug)
                out += rows_of(row.ep, spans)
            yield pd.DataFrame(out, columns=COLUMNS)

    kind = frames.schema["ep"].dataType.simpleString()
    return packed(frames, events, steps, slugs).mapInPandas(walk, SPAN.format(kind))


def assign_coarse(frames: DataFrame, events: DataFrame, steps: DataFrame, slugs: DataFrame | None = None, merge_text: bool = True, unmerged: tuple[str, ...] = ()) -> DataFrame:
    """The coarse spans of all episodes with frames: segments of motion and gripper groups by windows, then one walk an episode.

    Texts of moves after a release are merged into it but for tasks ``unmerged``, which ``slugs`` (ep, slug) tells.
    """
    groups = trajectory.gripper_groups(events)
    segments = trajectory.split_segments(trajectory.joined_segments(trajectory.motion_segments(frames), groups), groups)
    piece = lambda *more: F.array_sort(F.collect_list(F.struct("start", *more, "end", "left", "right")))
    extra = (
        segments.groupBy("ep").agg(piece().alias("segments"))
        .join(groups.groupBy("ep").agg(piece("frame", "kind").alias("groups")), "ep", "full")
    )

    by_task = slugs is not None
    extra = extra.join(slugs, "ep", "full") if slugs is not None else extra
    # of the states the goals tell heights alone
    heights = F.struct("f", *(F.col("state")[first + 2].alias(arm) for arm, first in trajectory.ARMS.items()))
    seen = frames.groupBy("ep").agg(F.array_sort(F.collect_list(heights)).alias("heights"))
    kind = frames.schema["ep"].dataType.simpleString()
    schema = to_arrow_schema(StructType.fromDDL(SPAN.format(kind)))
    arms = {(left, right): frozenset(a for a, there in zip(G.ARMS, (left, right)) if there) for left in (True, False, None) for right in (True, False, None)}

    def walk(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, EPISODES):
                part, out = batch.slice(at, EPISODES), []
                seen, steps, segments, groups = (lists(part.column(c)) for c in ("heights", "steps", "segments", "groups"))
                high = {arm: seen[1].field(arm).to_numpy(zero_copy_only=False) for arm in trajectory.ARMS}
                steps_all = [Step(t, k or "final", a, tuple(e or ())) for t, k, a, e in zip(*fields(steps[1], "text", "kind", "arm", "ends"))]
                parts_all = [Piece(a, b, arms[left, right]) for a, b, left, right in zip(*fields(segments[1], "start", "end", "left", "right"))]
                grips_all = [Piece(a, b, arms[left, right], k, f) for a, b, left, right, k, f in zip(*fields(groups[1], "start", "end", "left", "right", "kind", "frame"))]
                slugs = part.column("slug").to_pylist() if by_task else [None] * part.num_rows
                for k, (ep, slug) in enumerate(zip(part.column("ep").to_pylist(), slugs)):
                    rows, mine, parts, grips = (slice(*offsets[k : k + 2]) for offsets, _ in (seen, steps, segments, groups))
                    sorted_grips = sorted(grips_all[grips], key=lambda g: (g.start, g.frame, sorted(g.arms)))
                    merge = merge_text and not (by_task and slug in unmerged)
                    out += rows_of(ep, CoarseWalk(steps_all[mine], parts_all[parts], sorted_grips, rows.stop - rows.start, {arm: z[rows] for arm, z in high.items()}, merge).spans())
                yield pa.RecordBatch.from_arrays([pa.array(values, field.type) for values, field in zip(zip(*out), schema)], schema=schema)

    return seen.join(told(steps), "ep", "left").join(extra, "ep", "left").mapInArrow(walk, SPAN.format(kind))


def lists(column: pa.ListArray) -> tuple[list[int], pa.Array]:
    """Where each list of a column begins and ends, and the items of all."""
    offsets = column.offsets.to_numpy()
    return (offsets - offsets[0]).tolist(), column.values.slice(offsets[0], offsets[-1] - offsets[0])


def fields(items: pa.StructArray, *names: str) -> list[list]:
    return [plain(items.field(name)) for name in names]


def upcoming(points: DataFrame, events: DataFrame, kinds: list[str] | None = None, arms: list[str] | None = None) -> DataFrame:
    """For each point (ep, f, start) the boundary before the first later event of some kinds and arms; null without one.

    One window over points and events together, from the last frame back: linear in both.
    """
    wanted = events.filter((F.col("kind").isin(kinds) if kinds else F.lit(True)) & (F.col("arm").isin(arms) if arms else F.lit(True)))
    begin = F.coalesce("start_frame", "frame")
    marks = wanted.select("ep", F.col("frame").alias("f"), F.lit(None).cast("long").alias("start"), F.struct(begin.cast("long").alias("start_frame"), "arm", "kind").alias("e"), F.lit(1).alias("event"))
    both = points.select("ep", F.col("f").cast("long").alias("f"), F.col("start").cast("long").alias("start"), F.lit(None).cast(marks.schema["e"].dataType).alias("e"), F.lit(0).alias("event")).unionByName(marks)
    from pyspark.sql import Window

    later = Window.partitionBy("ep").orderBy(F.desc("f"), "event", F.desc("e")).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("next", F.last("e", ignorenulls=True).over(later)).filter("event = 0")
    named = F.concat(F.lit("before_gripper_"), F.col("next.arm"), F.lit("_"), F.col("next.kind"))
    return met.select("ep", "f", "start", (F.greatest("start", "next.start_frame") - F.when(F.col("next").isNotNull(), 1)).alias("frame"), named.alias("source"), F.concat(F.lit("gripper_"), F.col("next.kind")).alias("rule"))


def published(spans: DataFrame, goal: str = "goal", source: str = "source") -> DataFrame:
    """Spans with the labels of the real arms: left and right exchanged in goals, places and boundaries."""
    return spans.withColumn(goal, G.flip_places(G.flip_arms(F.col(goal)))).withColumn(source, G.flip_boundary(F.col(source)))


def flipped_scene(scene: Column) -> Column:
    """A map of the scene whose values left and right are exchanged."""
    return F.transform_values(scene, lambda k, v: G.flip_label(v))
