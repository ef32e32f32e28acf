"""The life-cycle of a job: which command leads from which state to which."""

JOB_STATES = "job long, status string, cancel_requested boolean, claims long, rejected long"
#: One row a command: whether it was accepted, and the job's state after it.
FOLDED = "job long, event_id long, command string, accepted boolean, status string, cancel_requested boolean, claims long, rejected long"
RUNNING = frozenset({"parsing", "synthesizing", "assembling"})

#: command -> (states it is allowed in, state it leads to). None stands for a job that isn't there yet.
TRANSITIONS = {
    "analyze": (frozenset({None}), "draft"),
    "start": (frozenset({"draft"}), "queued"),
    "claim": (frozenset({"queued"}), "parsing"),
    "planned": (frozenset({"parsing"}), "synthesizing"),
    "rendered": (frozenset({"synthesizing"}), "assembling"),
    "uploaded": (frozenset({"assembling"}), "done"),
    "error": (RUNNING, "failed"),
    "flag_seen": (RUNNING, "cancelled"),
    "resume": (frozenset({"cancelled", "failed"}), "queued"),
    "reassemble": (frozenset({"draft", "queued", "done", "failed", "cancelled"}), "queued"),
    "rescue": (RUNNING, "queued"),
    "delete": (frozenset({"draft", "queued", "done", "failed", "cancelled"}), None),
}
#: Commands after which nobody waits for a job to stop.
UNFLAGGED = ("claim", "start", "resume", "flag_seen", "rescue")


def begin() -> dict:
    """A job that isn't there yet, or no longer."""
    return {"status": None, "cancel": False, "claims": 0, "rejected": 0}


def fold(state: dict | None, command: str, online: bool = True) -> dict:
    """The state after a command. A command that isn't allowed changes nothing but the count of rejected ones; a deleted job is as one that never was."""
    state = dict(state or begin())
    if command == "cancel":
        if state["status"] == "queued" or (state["status"] in RUNNING and not online):
            state |= {"status": "cancelled", "cancel": False}
        elif state["status"] in RUNNING:
            state["cancel"] = True  # the worker sees it and stops
        else:
            state["rejected"] += 1
        return state
    if command not in TRANSITIONS or state["status"] not in TRANSITIONS[command][0]:
        state["rejected"] += 1
        return state
    if command == "delete":
        return begin()
    state["status"] = TRANSITIONS[command][1]
    if command in UNFLAGGED:
        state["cancel"] = False
    state["claims"] += command == "claim"
    return state


def fold_rows(state: dict | None, job: int, commands) -> tuple[dict, list[tuple]]:
    """The state after commands (event_id, command, online) in order, and a row of FOLDED for each."""
    held, rows = dict(state or begin()), []
    for event_id, command, online in commands:
        before, held = held["rejected"], fold(held, command, bool(online))
        accepted = held["rejected"] <= before
        rows.append((job, event_id, command, accepted, held["status"], held["cancel"], held["claims"], held["rejected"]))
    return held, rows
