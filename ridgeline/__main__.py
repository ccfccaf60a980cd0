"""``python -m ridgeline``: one tool run, listings, or an interactive prompt."""

from __future__ import annotations

import argparse
import os
import sys

from . import __version__, registry
from .sources.formats import EXTENSIONS


COMMANDS = {
    "bench": "tells whether benchmark mode is on", "benchoff": "runs tools once", "benchon": "runs tools ten times and gives the mean", "clear": "clears the screen (c, cls, clr)",
    "cwd": "changes the working folder (cd, dir)", "exit": "ends (logout, esc)", "help": "this list (h)", "licence": "the licence", "listtools": "all tools",
    "memprof": "memory in use", "pwd": "the working folder", "rasterformats": "grid formats and their extensions", "run": "runs a tool: run Slope in.dep;out.tif (r)",
    "toolargs": "a tool's arguments", "toolhelp": "a tool's description and arguments", "version": "the version (v)",
}


def session():
    from .session import local_session

    return local_session()


def command(line: str, state: dict) -> str | None:
    """One line of the prompt; None ends it."""
    word, _, rest = line.strip().partition(" ")
    word, rest = word.lower(), rest.strip()
    if word in ("exit", "logout", "esc"):
        return None
    if word in ("", "c", "cls", "clr", "clear"):
        return "" if not word else "\x1b[2J"
    if word in ("cwd", "cd", "dir"):
        state["folder"] = rest or state["folder"]
        return state["folder"]
    if word == "pwd":
        return state["folder"]
    if word in ("v", "version"):
        return __version__
    if word == "listtools":
        return "\n".join(f"{n:<30}{t}" for n, t in registry.list_tools())
    if word in ("toolhelp", "toolargs"):
        return registry.help_text(rest)
    if word == "rasterformats":
        return "\n".join(f"{f:<16}{' '.join(e)}" for f, e in EXTENSIONS.items())
    if word in ("licence", "license"):
        return "No licence is stated for this repository."
    if word in ("benchon", "benchoff"):
        state["bench"] = word == "benchon"
    if word in ("bench", "benchon", "benchoff"):
        return f"benchmark mode {'on' if state.get('bench') else 'off'}"
    if word == "memprof":
        import resource

        return f"largest memory of this process: {resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024:.1f} MB"
    if word in ("r", "run"):
        name, _, text = rest.partition(" ")
        runs = 10 if state.get("bench") else 1
        out = [registry.run(session(), name, registry.split_arguments(text), state["folder"]) for _ in range(runs)]
        return "" if not isinstance(out[0], float) else f"mean of {runs}: {sum(out) / runs:.3f} s"
    known = "\n".join(f"{name:<16}{text}" for name, text in COMMANDS.items())
    return known if word in ("h", "help") else f"unknown command {word!r}; known are\n{known}"


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="ridgeline")
    p.add_argument("-run", metavar="TOOL")
    p.add_argument("-args", default="", help="separated by ; or ,")
    p.add_argument("-cwd", default=os.getcwd())
    p.add_argument("-listtools", action="store_true")
    p.add_argument("-toolhelp", metavar="TOOL")
    p.add_argument("-toolargs", metavar="TOOL")
    p.add_argument("-help", action="help")
    p.add_argument("-version", action="version", version=__version__)
    a = p.parse_args(argv)
    state = {"folder": a.cwd}
    if a.listtools:
        print(command("listtools", state))
    elif a.toolhelp or a.toolargs:
        print(registry.help_text(a.toolhelp or a.toolargs))
    elif a.run:
        got = registry.run(session(), a.run, registry.split_arguments(a.args), a.cwd)
        if hasattr(got, "show"):
            got.show(200, truncate=False)
    else:
        for line in sys.stdin:
            said = command(line, state)
            if said is None:
                break
            print(said)
    return 0


if __name__ == "__main__":
    sys.exit(main())
