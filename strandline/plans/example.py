"""A small program in which each rule of the scan has a case, and what each of its functions is by those rules."""

from __future__ import annotations

import re

#: Instructions of each function, a line each.
PROGRAM = {
    "open_it": "mov esi,0x0\ncall 1 <open@plt>",
    "read_it": "call 1 <read@plt>",
    "transfer": "call 1 <read_it>\ncall 2 <send@plt>",
    "serve": "call 1 <open_it>\nmov edi,eax\ncall 2 <transfer>",
    "upload": "call 1 <accept@plt>\nmov edi,eax\ncall 2 <transfer>",
    "register": "mov rax,QWORD PTR [rip+0x1000]\nmov DWORD PTR [rax+0x8],edi",
    "resolve": "mov rdx,QWORD PTR [rip+0x1000]\nmov eax,DWORD PTR [rdx+0x8]",
    "feeder": "call 1 <open_it>\nmov edi,eax\ncall 2 <register>",
    "drainer": "call 1 <resolve>\nmov edi,eax\ncall 2 <read@plt>\ncall 3 <send@plt>",
    "flush": "mov esi,DWORD PTR [rbx+0x30]\ncall 1 <sendfile@plt>",
    "append": "mov DWORD PTR [rdi+0x30],esi",
    "queue": "call 1 <open_it>\nmov esi,eax\ncall 2 <append>",
    "sender": "mov rsi,QWORD PTR [rbx+0x58]\ncall 1 <send@plt>",
    "filler": "mov rsi,QWORD PTR [rbx+0x58]\ncall 1 <read@plt>",
    "copier": "mov rdi,QWORD PTR [rbx+0x58]\ncall 1 <memcpy@plt>",
    "direct": "lea rsi,[rbp-0x40]\ncall 1 <read@plt>\nlea rsi,[rbp-0x40]\ncall 2 <send@plt>",
    "near": "call 1 <mid>",
    "mid": "call 1 <transfer>",
    "far": "call 1 <near>",
}
#: By hand: a descriptor that is handed to a helper that reads and sends; one that goes into a table, and one that comes
#: out of it and is read and sent; one that is queued for sendfile; a buffer that is sent elsewhere and read into here; a
#: buffer that is read into and sent in one function.
ENDPOINTS = {"serve": "fd_arg", "feeder": "fd_table", "drainer": "fd_table", "queue": "fd_queue", "filler": "crossbuf", "direct": "samefunc"}

#: (caller, callee as it is named)
CALLS = [(f, name) for f, text in PROGRAM.items() for name in re.findall(r"<([^>+@]+)", text)]
