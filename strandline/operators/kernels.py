"""Order-dependent data-flow rules over one function's instructions.

A kernel is a pure function from the ordered instructions of a function (and small per-program summaries) to findings;
``run_kernels`` applies it to grouped rows. Rules, not recipes: each docstring says what makes a finding.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Container, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from strandline.functions import dimensions as D

#: 32-bit spellings of 64-bit registers.
WIDE = {"eax": "rax", "ebx": "rbx", "ecx": "rcx", "edx": "rdx", "esi": "rsi", "edi": "rdi", "ebp": "rbp", "esp": "rsp"} | {f"r{n}d": f"r{n}" for n in range(8, 16)}
_CALL = re.compile(r"<([^>+@]+)")
_MEMORY = re.compile(r"\[([a-z0-9]+)(?:([+-])(0x[0-9a-fA-F]+|\d+))?\]")
_RIP = re.compile(r"\[rip([+-])(0x[0-9a-fA-F]+)\]")
_NUMBER = re.compile(r"^-?(0x[0-9a-fA-F]+|\d+)$")
#: Spellings of instructions and operands that a worker remembers what they mean of.
_REMEMBERED = 1 << 16


class Insn(NamedTuple):
    """One instruction: operation, operands, the callee of a call, address and size."""

    op: str
    args: tuple[str, ...]
    callee: str | None
    pc: int
    size: int


def parse(text: str, pc: int = 0, size: int = 0) -> Insn:
    return Insn(*_parts(text or ""), pc, size)


@lru_cache(_REMEMBERED)
def _parts(text: str) -> tuple[str, tuple[str, ...], str | None]:
    op, _, rest = text.strip().partition(" ")
    if op.startswith("call"):
        named = _CALL.search(rest)
        return "call", (rest.strip(),), named[1] if named else None
    depth, args, word = 0, [], ""
    for ch in rest.split("#")[0]:
        depth += (ch == "[") - (ch == "]")
        if ch == "," and not depth:
            args.append(word.strip())
            word = ""
        else:
            word += ch
    if word.strip():
        args.append(word.strip())
    return op, tuple(args), None


@lru_cache(_REMEMBERED)
def register(arg: str | None) -> str | None:
    """The 64-bit name of a register operand; None for memory and numbers."""
    if not arg or "[" in arg or _NUMBER.match(arg):
        return None
    return WIDE.get(arg, arg)


@lru_cache(_REMEMBERED)
def memory(arg: str) -> tuple[str, int] | None:
    """(base register, displacement) of a simple memory operand."""
    m = _MEMORY.search(arg)
    if not m or m[1] == "rip":
        return None
    return WIDE.get(m[1], m[1]), int(m[3] or "0", 0) * (-1 if m[2] == "-" else 1)


@lru_cache(_REMEMBERED)
def slot(arg: str) -> str | None:
    """A stack slot, named by its base and displacement."""
    m = memory(arg)
    return f"{m[0]}{m[1]:+d}" if m and m[0] in ("rbp", "rsp") else None


def global_address(i: Insn, arg: str) -> int | None:
    """The absolute address of a rip-relative operand."""
    m = _RIP.search(arg)
    return i.pc + i.size + int(m[2], 16) * (-1 if m[1] == "-" else 1) if m else None


def number(arg: str) -> int | None:
    return int(arg, 0) if _NUMBER.match(arg) else None


def constant_before(code: list[Insn], at: int, reg: str, back: int = D.CONSTANT_BACK) -> int | None:
    """The constant in a register by its last write among ``back`` rows; None if that isn't a constant or zeroing."""
    for i in reversed(code[max(0, at - back) : at]):
        if i.op == "call" or not i.args or register(i.args[0]) != reg or i.op in ("cmp", "test"):
            continue
        if i.op == "xor" and len(i.args) == 2 and register(i.args[1]) == reg:
            return 0
        return number(i.args[1]) if i.op == "mov" and len(i.args) == 2 else None
    return None


def open_direction(code: list[Insn], at: int) -> str:
    """Whether an open call reads or writes: creat writes, stream opens read; else by the flags constant; with unknown
    flags a plausible mode constant (1 to 0o777) means creation."""
    name = code[at].callee or ""
    if name.startswith("creat"):
        return "write"
    if "fopen" in name or name.startswith("freopen"):
        return "read"
    shift = 1 if name.startswith("openat") else 0
    flags = constant_before(code, at, D.ARGUMENTS[1 + shift])
    if flags is not None:
        return "write" if flags & (D.O_WRONLY | D.O_RDWR | D.O_CREAT | D.O_TRUNC | D.O_APPEND) else "read"
    mode = constant_before(code, at, D.ARGUMENTS[2 + shift])
    return "write" if mode is not None and 1 <= mode <= 0o777 else "read"


def slot_from_open(code: list[Insn], at: int, where: str) -> bool:
    """Whether a slot's last write (249 rows back) stores what an open call returned (7 rows further)."""
    for k in range(at - 1, max(-1, at - 1 - D.SLOT_BACK), -1):
        i = code[k]
        if i.op == "mov" and len(i.args) == 2 and slot(i.args[0]) == where:
            near = next((c for c in reversed(code[max(0, k - D.SLOT_CALL_BACK) : k]) if c.op == "call"), None)
            return near is not None and near.callee in D.OPEN_FAMILY.split()
    return False


def channel(code: list[Insn], at: int, reg: str, depth: int = 0) -> str:
    """``local`` or ``external``: where an output's descriptor or stream comes from. Descriptor 2 and global descriptors
    are local, global streams external, slots filled by an open local; copies are followed, the unknown is external."""
    if depth > D.CHANNEL_DEPTH:
        return "external"
    for k in range(at - 1, max(-1, at - 1 - D.CHANNEL_BACK), -1):
        i = code[k]
        if i.op == "call" or len(i.args) != 2 or register(i.args[0]) != reg or i.op in ("cmp", "test"):
            continue
        source = i.args[1]
        if number(source) is not None:
            return "local" if number(source) == 2 else "external"
        if "[rip" in source:
            return "local" if i.args[0] in WIDE else "external"
        if slot(source):
            return "local" if slot_from_open(code, k, slot(source)) else "external"
        if register(source) and i.op.startswith("mov"):
            return channel(code, k, register(source), depth + 1)
        return "external"
    return "external"


def is_external(code: list[Insn], at: int) -> bool:
    name = code[at].callee
    if name in D.ALWAYS_EXTERNAL.split():
        return True
    return name in D.CHANNEL_ARGUMENT and channel(code, at, D.CHANNEL_ARGUMENT[name]) == "external"


def same_function(code: list[Insn]) -> list[str]:
    """slots that a content read fills and an external output sends, copies between slots followed to a fixpoint."""
    held: dict[str, str] = {}
    filled, sent, copies = set(), set(), set()
    for at, i in enumerate(code):
        if i.op == "call":
            if i.callee in D.CONTENT_READ and (s := held.get(D.CONTENT_READ[i.callee])):
                filled.add(s)
            if i.callee in D.OUTPUT and (s := held.get(D.OUTPUT[i.callee])) and is_external(code, at):
                sent.add(s)
            if i.callee in D.COPIES.split() and held.get("rdi") and held.get("rsi"):
                copies.add((held["rsi"], held["rdi"]))
            for r in D.CALLER_SAVED:
                held.pop(r, None)
            continue
        target = register(i.args[0]) if i.args else None
        if not target:
            continue
        source = None
        if i.op == "lea" and len(i.args) == 2:
            source = slot(i.args[1])
        elif i.op == "mov" and len(i.args) == 2 and i.args[0] not in WIDE and register(i.args[1]):
            source = held.get(register(i.args[1]))
        if source:
            held[target] = source
        else:
            held.pop(target, None)
    while new := {b for a, b in copies if a in filled} - filled:
        filled |= new
    return sorted(filled & sent)


def char_loop(code: list[Insn]) -> list[str]:
    """a character that a getc returns goes to a putc; not part of the union of rules."""
    live, found = set(), []
    for i in code:
        if i.op == "call":
            if i.callee in D.PUTC.split() and "rdi" in live:
                found.append(i.callee)
            live = {r for r in live if r not in D.CALLER_SAVED}
            if i.callee in D.GETC.split():
                live.add("rax")
        elif i.op.startswith("mov") and len(i.args) == 2 and register(i.args[0]):
            (live.add if register(i.args[1]) in live else live.discard)(register(i.args[0]))
    return found


class Flow:
    """Registers and slots that hold a tracked value, as it moves. Slots only grow; calls clear caller-saved registers."""

    def __init__(self):
        self.registers: set[str] = set()
        self.slots: set[str] = set()

    def step(self, i: Insn) -> None:
        if i.op == "call":
            self.registers -= D.CALLER_SAVED
        elif i.op.startswith("mov") and len(i.args) == 2:
            held = register(i.args[1]) in self.registers if register(i.args[1]) else slot(i.args[1]) in self.slots
            if register(i.args[0]):
                (self.registers.add if held else self.registers.discard)(register(i.args[0]))
            elif held and slot(i.args[0]):
                self.slots.add(slot(i.args[0]))
        elif i.args and register(i.args[0]) and i.op not in ("cmp", "test", "push"):
            self.registers.discard(register(i.args[0]))


def _passes(code: list[Insn], origin: Callable[[int], bool], hit: Callable[[int, set[str]], bool], named: Container[str], times: int = 2) -> list[str]:
    """Callees that are hit, which only those ``named`` can be."""
    flow, found = Flow(), []
    if not any(i.callee in named for i in code):
        return found
    for _ in range(times):  # a slot filled late in a loop is seen early in the second pass
        for at, i in enumerate(code):
            if i.op == "call" and hit(at, flow.registers):
                found.append(i.callee or "?")
            flow.step(i)
            if i.op == "call" and origin(at):
                flow.registers.add("rax")
    return sorted(set(found))


def passes_descriptor(code: list[Insn], read_wrappers: frozenset[str], helpers: frozenset[str]) -> list[str]:
    """a descriptor from a read-only open, or from a wrapper that reads, is an argument of a transfer helper."""
    origin = lambda at: code[at].callee in read_wrappers or (code[at].callee in D.OPEN_FAMILY.split() and open_direction(code, at) == "read")
    return _passes(code, origin, lambda at, held: code[at].callee in helpers and bool(held & set(D.ARGUMENTS)), helpers)


def dominant_global(code: list[Insn]) -> int | None:
    """The global that most 64-bit moves touch; of ties the first."""
    seen: dict[int, int] = {}
    for i in code:
        if i.op == "mov" and any("QWORD" in a for a in i.args):
            for a in i.args:
                if (g := global_address(i, a)) is not None:
                    seen[g] = seen.get(g, 0) + 1
    return max(seen, key=seen.get) if seen else None


def registrar(code: list[Insn]) -> list[tuple[int, int, int]]:
    """(argument number, global, offset) of an argument that a function of at most 150 rows stores off the stack."""
    if len(code) > D.REGISTRAR_SIZE or (g := dominant_global(code)) is None:
        return []
    holds = {r: n for n, r in enumerate(D.ARGUMENTS)}
    spilled: dict[str, int] = {}
    for i in code:
        if i.op == "call":
            holds = {r: n for r, n in holds.items() if r not in D.CALLER_SAVED}
        elif i.op == "mov" and len(i.args) == 2:
            source = register(i.args[1])
            n = holds.get(source) if source else spilled.get(slot(i.args[1]) or "")
            target = register(i.args[0])
            if target:
                holds.pop(target, None)
                if n is not None:
                    holds[target] = n
            elif n is not None and slot(i.args[0]):
                spilled[slot(i.args[0])] = n
            elif n is not None and (m := memory(i.args[0])) and m[1] >= 0:
                return [(n, g, m[1])]
        elif i.args and register(i.args[0]) and i.op not in ("cmp", "test", "push"):
            holds.pop(register(i.args[0]), None)
    return []


def resolver(code: list[Insn]) -> list[tuple[int, int]]:
    """F8: (global, offset) that a function of at most 80 rows returns from off the stack."""
    if len(code) > D.RESOLVER_SIZE or (g := dominant_global(code)) is None:
        return []
    for i in reversed(code):
        if i.op.startswith("mov") and len(i.args) == 2 and register(i.args[0]) == "rax" and "[" in i.args[1]:
            m = memory(i.args[1])
            return [(g, m[1])] if m and m[0] not in ("rbp", "rsp") and m[1] >= 0 else []
    return []


def feeds(code: list[Insn], read_wrappers: frozenset[str], registrars: dict[str, int]) -> list[str]:
    """a read descriptor is the descriptor argument of a registrar (name: argument number)."""
    origin = lambda at: code[at].callee in read_wrappers or (code[at].callee in D.OPEN_FAMILY.split() and open_direction(code, at) == "read")
    return _passes(code, origin, lambda at, held: code[at].callee in registrars and D.ARGUMENTS[registrars[code[at].callee]] in held, registrars)


def drains(code: list[Insn], resolvers: frozenset[str]) -> list[str]:
    """what a resolver returns is the descriptor argument of a content read."""
    return _passes(code, lambda at: code[at].callee in resolvers, lambda at, held: D.FD_READ.get(code[at].callee) in held, D.FD_READ)


def mount_offsets(code: list[Insn]) -> list[int]:
    """positive field offsets that the in-descriptor of sendfile is loaded from, among the 7 rows before."""
    found = []
    for at, i in enumerate(code):
        if i.op == "call" and i.callee in ("sendfile", "sendfile64"):
            load = next((c for c in reversed(code[max(0, at - 7) : at]) if c.op == "mov" and len(c.args) == 2 and register(c.args[0]) == "rsi"), None)
            if load and (m := memory(load.args[1])) and m[1] > 0:
                found.append(m[1])
    return sorted(set(found))


def stores_at(code: list[Insn], offsets: frozenset[int]) -> list[int]:
    """field offsets among ``offsets`` that the function stores to, off the stack."""
    return sorted({m[1] for i in code if i.op == "mov" and len(i.args) == 2 and (m := memory(i.args[0])) and m[0] not in ("rbp", "rsp") and m[1] in offsets})


def touches(code: list[Insn], offsets: frozenset[int], writers: frozenset[str], ahead: int = D.TOUCH_AHEAD) -> int:
    """how many touches of struct offsets a call of ``writers`` follows within ``ahead`` rows, its own included."""
    calls = [i.callee in writers for i in code]
    return sum(any(calls[at : at + ahead]) for at, i in enumerate(code) if any((m := memory(a)) and m[0] not in ("rbp", "rsp") and m[1] in offsets for a in i.args))


def send_offsets(code: list[Insn]) -> list[int]:
    """Positive struct offsets that buffers of external outputs are loaded from, copies followed four deep."""
    found = set()
    for at, i in enumerate(code):
        if i.op == "call" and i.callee in D.OUTPUT and is_external(code, at):
            reg, depth = D.OUTPUT[i.callee], 0
            for c in reversed(code[max(0, at - D.OFFSET_BACK) : at]):
                if c.op in ("mov", "lea") and len(c.args) == 2 and register(c.args[0]) == reg:
                    if (m := memory(c.args[1])) and m[0] not in ("rbp", "rsp"):
                        if m[1] > 0:
                            found.add(m[1])
                        break
                    reg, depth = register(c.args[1]), depth + 1
                    if not reg or depth > D.OFFSET_DEPTH:
                        break
    return sorted(found)


def path_provenance(code: list[Insn]) -> dict[str, int]:
    """how many opened paths are constants, computed, parameters or unknown, by the last write 39 rows back."""
    kinds = dict.fromkeys(("const", "computed", "param", "unknown"), 0)
    for at, i in enumerate(code):
        if i.op != "call" or i.callee not in D.PATH_ARGUMENT:
            continue
        reg, kind, written = D.PATH_ARGUMENT[i.callee], "unknown", False
        for c in reversed(code[max(0, at - D.PATH_BACK) : at]):
            if c.op == "call":
                if reg == "rax":
                    kind, written = "computed", True
                    break
            elif len(c.args) == 2 and register(c.args[0]) == reg and c.op not in ("cmp", "test"):
                source = c.args[1]
                if "[rip" in source or number(source) is not None:
                    kind = "const"
                elif "[" in source:
                    kind = "computed"
                elif register(source):
                    reg = register(source)
                    continue
                written = True
                break
        if not written and at <= D.PATH_BACK and reg in D.ARGUMENTS:
            kind = "param"
        kinds[kind] += 1
    return kinds


def condition_budget(edges: dict[str, list[str]], start: str, tests: frozenset[str], budget: int = 80) -> bool:
    """G8: whether a test is met among the first ``budget`` nodes taken from a breadth-first queue; repeats count."""
    queue, taken = [start], 0
    while queue and taken < budget:
        node = queue.pop(0)
        taken += 1
        if node in tests:
            return True
        queue.extend(edges.get(node, ()))
    return False


KERNELS: dict[str, Callable[[list[Insn]], list]] = {
    "samefunc": same_function,
    "char_loop": char_loop,
    "mount_offsets": mount_offsets,
    "send_offsets": send_offsets,
    "registrar": registrar,
    "resolver": resolver,
    "path_provenance": lambda code: [(k, n) for k, n in path_provenance(code).items() if n],
}


#: Rows of a thin open wrapper at most; calls down to a read or a write; calls up from a mount writer.
WRAPPER_SIZE, HELPER_DEPTH, QUEUE_DEPTH = 60, 3, 2


def facts(code: list[Insn]) -> dict:
    """What a program's summary asks of one function."""
    opens = [at for at, i in enumerate(code) if i.callee in D.OPEN_FAMILY.split()]
    stores = {m[1] for i in code if i.op == "mov" and len(i.args) == 2 and (m := memory(i.args[0])) and m[0] not in ("rbp", "rsp") and m[1] > 0}
    touched = {m[1] for i in code for a in i.args if (m := memory(a)) and m[0] not in ("rbp", "rsp") and m[1] > 0}
    return {
        "calls": sorted({i.callee for i in code if i.callee}), "size": len(code), "reads": any(open_direction(code, at) == "read" for at in opens),
        "registrar": registrar(code), "resolver": resolver(code), "mounts": mount_offsets(code), "sends": send_offsets(code), "stores": sorted(stores), "touched": sorted(touched),
    }


def _callers(calls: dict[str, set], seed: set[str], depth: int) -> set[str]:
    """Functions that reach one of ``seed`` by at most ``depth`` calls, with ``seed``."""
    found, edge = set(seed), set(seed)
    for _ in range(depth):
        edge = {f for f, c in calls.items() if c & edge} - found
        found |= edge
    return found


def summary(program: dict[str, dict]) -> dict:
    """Read wrappers, transfer helpers, tables and offsets of a program from the facts of its functions."""
    calls = {f: set(x["calls"]) for f, x in program.items()}
    opening = set(D.OPEN_FAMILY.split())
    wrappers: set[str] = set()
    while new := {f for f, x in program.items() if x["size"] <= WRAPPER_SIZE and calls[f] & (opening | wrappers)} - wrappers:
        wrappers |= new
    # a wrapper reads if it opens for reading or calls one that does; those that only call each other read too
    reading = {f for f in wrappers if program[f]["reads"]}
    while new := {f for f in wrappers if calls[f] & reading} - reading:
        reading |= new
    idle = {f for f in wrappers if not calls[f] & opening}
    while gone := {f for f in idle if calls[f] & wrappers - idle - {f}}:
        idle -= gone
    reading |= idle
    direct = lambda prims: {f for f, c in calls.items() if c & set(prims)}
    readers, writers = (_callers(calls, direct(x), HELPER_DEPTH) for x in (D.FD_READ, D.FD_WRITE.split()))
    tables = {(g, o) for x in program.values() for _, g, o in map(tuple, x["registrar"])} & {tuple(t) for x in program.values() for t in x["resolver"]}
    mounts = {o for x in program.values() for o in x["mounts"]}
    queue = _callers(calls, {f for f, x in program.items() if mounts & set(x["stores"])}, QUEUE_DEPTH) if mounts else set()
    return {
        "wrappers": sorted(reading), "helpers": sorted(readers & writers), "writers": sorted(writers), "queue": sorted(queue), "mounts": sorted(mounts),
        "registrars": {f: n for f, x in program.items() for n, g, o in x["registrar"] if (g, o) in tables},
        "resolvers": sorted(f for f, x in program.items() if any(tuple(t) in tables for t in x["resolver"])),
        "offsets": sorted({o for x in program.values() for o in x["sends"]}),
    }


def told(program: dict[str, dict]) -> Iterator[tuple[str, dict]]:
    """(function, summary) of a program's functions: of the program's summary only what the function itself calls, stores
    to or touches, and its own name. No kernel asks for more, and all of them together are no longer than the facts."""
    whole = summary(program)
    named = {k: frozenset(whole[k]) for k in ("wrappers", "helpers", "queue", "resolvers", "writers", "mounts", "offsets")}
    for f, x in program.items():
        own = {"wrappers": x["calls"], "helpers": x["calls"], "queue": x["calls"], "resolvers": x["calls"], "writers": [f], "mounts": x["stores"], "offsets": x["touched"]}
        yield f, {k: [v for v in held if v in named[k]] for k, held in own.items()} | {"registrars": {c: whole["registrars"][c] for c in x["calls"] if c in whole["registrars"]}}


def fd_delegation(name: str, code: list[Insn], s: dict) -> list[tuple[str, list]]:
    """the first of fd_arg (F5), fd_table (F9, or F10 in a function that reaches an external write) and fd_queue
    (F5 into functions near a mount writer) that a function is, with what it calls."""
    wrappers = frozenset(s["wrappers"])
    if found := passes_descriptor(code, wrappers, frozenset(s["helpers"])):
        return [("fd_arg", found)]
    found = feeds(code, wrappers, s["registrars"])
    if not found and name in s["writers"]:
        found = drains(code, frozenset(s["resolvers"]))
    if found:
        return [("fd_table", found)]
    found = passes_descriptor(code, wrappers, frozenset(s["queue"]))
    return [("fd_queue", found)] if found else []


#: Kernels that ask for the summary of the whole program: from name, code and summary to (tag, evidence).
PROGRAM_KERNELS: dict[str, Callable[[str, list[Insn], dict], list]] = {
    "crossbuf": lambda name, code, s: [("crossbuf", [n])] if (n := touches(code, frozenset(s["offsets"]), frozenset(D.CONTENT_READ))) else [],
    "writes_send_buffer": lambda name, code, s: [("writes_send_buffer", [n])] if (n := touches(code, frozenset(s["offsets"]), frozenset(D.BUFFER_WRITERS.split()))) else [],
    "mount_writer": lambda name, code, s: [("mount_writer", found)] if (found := stores_at(code, frozenset(s["mounts"]))) else [],
    "fd_delegation": fd_delegation,
}
FINDINGS = "target_id string, function string, tag string, evidence string"


_FACTS = "target_id string, function string, facts string"


def _code(rows: pa.Table) -> list[Insn]:
    seq, text, pc, size = (rows.column(c).to_pylist() for c in ("seq", "instruction", "pc", "size"))
    order = sorted(range(len(seq)), key=lambda k: (seq[k] is None, seq[k] or 0))
    return [parse(text[k], int(pc[k] or 0), int(size[k] or 0)) for k in order]


def _strings(columns: str, rows: list[tuple]) -> pa.Table:
    names = [c.split()[0] for c in columns.split(", ")]
    return pa.table({c: pa.array([r[k] for r in rows], pa.string()) for k, c in enumerate(names)})


def run_kernels(insns: DataFrame, names: tuple[str, ...] = (*KERNELS, *PROGRAM_KERNELS)) -> DataFrame:
    """(target_id, function, tag, evidence) of rows (target_id, function, seq, pc, size, instruction).

    A group is one function, sorted in its task; pseudo-functions .plt are left out before the shuffle. Summaries of
    programs come from facts of their functions, a row each, before the kernels that need them; each function is told the
    part of the summary that is about it (see told). Null texts count as instructions without effect; an empty table gives
    no rows.
    """
    alone, whole = [n for n in names if n in KERNELS], [n for n in names if n not in KERNELS]

    def findings(key: tuple, rows: pa.Table, about: dict | None) -> pa.Table:
        code, (target, function) = _code(rows), (k.as_py() for k in key)
        found = [(target, function, name, str(x)) for name in alone for x in KERNELS[name](code)]
        found += [(target, function, tag, str(x)) for name in whole for tag, xs in PROGRAM_KERNELS[name](function, code, about) for x in xs]
        return _strings(FINDINGS, found)

    def fact(key: tuple, rows: pa.Table) -> pa.Table:
        return _strings(_FACTS, [(*(k.as_py() for k in key), json.dumps(facts(_code(rows))))])

    def about(key: tuple, rows: pa.Table) -> pa.Table:
        program = {f: json.loads(x) for f, x in zip(rows.column("function").to_pylist(), rows.column("facts").to_pylist(), strict=True)}
        return _strings(_FACTS, [(key[0].as_py(), f, json.dumps(x)) for f, x in told(program)])

    kept = insns.filter("function not in ('.plt', '.plt.sec')").select("target_id", "function", "seq", "pc", "size", "instruction")
    functions = kept.groupBy("target_id", "function")
    if not whole:
        return functions.applyInArrow(lambda key, rows: findings(key, rows, None), FINDINGS)
    each = functions.applyInArrow(fact, _FACTS).groupBy("target_id").applyInArrow(about, _FACTS)
    return functions.cogroup(each.groupBy("target_id", "function")).applyInArrow(lambda key, rows, one: findings(key, rows, json.loads(one.column("facts")[0].as_py())), FINDINGS)


def strip_c(source: str) -> str:
    """C text with comments and the insides of string and character literals blanked, line by line as long as before."""
    pattern = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][0] == "/" else m[0][0] + " " * (len(m[0]) - 2) + m[0][-1], source)


def c_functions(source: str) -> Iterator[tuple[str, int, int, str]]:
    """(name, first line, last line, body) of each function at brace depth 0."""
    text = strip_c(source)
    depth, head, start, name = 0, 0, 0, None
    for m in re.finditer(r"[{};]", text):
        ch, at = m[0], m.start()
        if ch == "{":
            if depth == 0:
                found = re.findall(r"([A-Za-z_]\w*)\s*\([^;{}]*\)\s*(?:[A-Za-z_][\w\s]*)?$", text[head:at])
                name = found[-1] if found and found[-1] not in ("if", "while", "for", "switch") else None
                start = at
            depth += 1
        elif ch == "}":
            depth = max(0, depth - 1)
            if depth == 0:
                if name:
                    yield name, text.count("\n", 0, start) + 1, text.count("\n", 0, at) + 1, text[start : at + 1]
                head, name = at + 1, None
        elif depth == 0:
            head = at + 1
