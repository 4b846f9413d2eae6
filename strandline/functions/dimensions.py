"""Word lists, symbol sets and bounds that results depend on. Fixed values, in their natural order; maps from symbols to
registers are grouped by register."""

# --- Fixed values: effect categories of external symbols -------------------------------------------------------------
EFFECTS = {
    "privilege_identity": "setuid seteuid setreuid setresuid setgid setegid setregid setresgid setgroups initgroups setfsuid setfsgid",
    "capability": "capset capsetp cap_set_proc prctl chroot pivot_root unshare setns",
    "exec": "execve execv execvp execvpe execl execlp execle fexecve execveat system popen posix_spawn posix_spawnp dlopen",
    "file_mutation": "chmod fchmod fchmodat chown fchown lchown fchownat unlink unlinkat rename renameat renameat2 link linkat symlink symlinkat mkdir mkdirat rmdir mknod truncate ftruncate creat creat64 open open64 openat openat64",
    "mount": "mount umount umount2",
    "rlimit": "setrlimit prlimit prlimit64 setpriority",
}
FILE_READ = "read pread pread64 readv preadv fread fread_unlocked fgets fgets_unlocked fgetc getc getc_unlocked getline getdelim fscanf __isoc99_fscanf mmap mmap64 sendfile sendfile64 opendir fdopendir readdir readdir64 readdir_r scandir scandir64 fopen fopen64 freopen freopen64 fdopen open open64 openat openat64"
READ_ACCESS = "open open64 openat openat64 fopen fopen64 freopen read pread pread64 readv fread fread_unlocked fgets fgets_unlocked getline getdelim mmap mmap64 opendir readdir scandir"

# --- Fixed values: keywords of names, files, parameters, locals and types --------------------------------------------
NAME_KEYWORDS = "auth passwd password pubkey cred login verify access perm policy sudoers cmnd command refer privile principal allow deny permit grant secure session ident token sign chroot setuid exec match check".split()
FILE_KEYWORDS = "auth priv pass login cred perm polic access sudoers exec session secure cap chan pty user sign key referer sftp ftpcmd privop".split()
PARAM_KEYWORDS = "passwd password pwd uid gid user cred pubkey key path file cmd command mode perm addr host refer sig token principal auth name dir".split()
PARAM_TYPE_KEYWORDS = "passwd uid_t gid_t cap mode_t sockaddr".split()
LOCAL_KEYWORDS = "password passwd pwd crypt salt hash shadow uid gid cred key pubkey sig token principal path file cmd command perm mode addr host refer user group cap secret nonce cookie ticket session priv".split()
TYPE_KEYWORDS = "passwd group spwd sockaddr stat cap_ in_addr termios ucred rlimit pam".split()

# --- Fixed values: patterns of string literals -----------------------------------------------------------------------
SYSTEM_PATH = r"^/(etc|var|tmp|usr|bin|sbin|dev|proc|lib|root)\b|^/[a-z]+/"
SHELL = r"/bin/sh|/bin/bash|(^|/)(sh|bash|dash)$"
CREDENTIAL = r"(?i)uid|gid|user|passwd|shadow|root|group|privile|cred|login|setuid"
CAPABILITY = r"(?i)cap_|chroot|capab|keepcap"

# --- Fixed values: name patterns of label resolution -----------------------------------------------------------------
AUTHZ = r"(?i)auth|passwd|password|pubkey|verify|sudoers|cmnd|referer|referrer|principal|access|chkpass"
BOOKKEEPING = r"(?i)log|cache|record|send|recv|_get|_set|free|init|reset|dump|msg|scheme|banner|info|count|notify|debug"
CLEANUP = r"(?i)cleanup|_free$|destroy|_exit|pidfile|scoreboard|reset|disallow"

# --- Fixed values: data-flow primitives and the argument register that matters ---------------------------------------
CONTENT_READ = {"fread": "rdi", "fread_unlocked": "rdi", "fgets": "rdi", "fgets_unlocked": "rdi", "getline": "rdi", "getdelim": "rdi", "read": "rsi", "pread": "rsi", "pread64": "rsi", "readv": "rsi"}
OUTPUT = {"send": "rsi", "sendto": "rsi", "write": "rsi", "writev": "rsi", "pwrite": "rsi", "pwrite64": "rsi", "printf": "rsi", "fwrite": "rdi", "fwrite_unlocked": "rdi", "fputs": "rdi", "fputs_unlocked": "rdi", "puts": "rdi", "__printf_chk": "rdx", "fprintf": "rdx", "vfprintf": "rdx"}
ALWAYS_EXTERNAL = "send sendto sendmsg sendfile sendfile64 writev puts printf __printf_chk putchar putchar_unlocked"
CHANNEL_ARGUMENT = {"write": "rdi", "pwrite": "rdi", "pwrite64": "rdi", "fprintf": "rdi", "vfprintf": "rdi", "fwrite": "rcx", "fwrite_unlocked": "rcx", "fputs": "rsi", "fputs_unlocked": "rsi", "putc": "rsi", "fputc": "rsi"}
OPEN_FAMILY = "open open64 openat openat64 fopen fopen64 freopen creat creat64"
COPIES = "memcpy memmove strcpy strncpy strlcpy stpcpy strcat strncat"
FD_READ = {"read": "rdi", "pread": "rdi", "pread64": "rdi", "readv": "rdi", "recv": "rdi", "getc": "rdi", "fgetc": "rdi", "getc_unlocked": "rdi", "fgetc_unlocked": "rdi", "fread": "rcx", "fread_unlocked": "rcx", "fgets": "rdx", "fgets_unlocked": "rdx", "getline": "rdx", "getdelim": "rdx"}
FD_WRITE = "send sendto sendmsg sendfile sendfile64 write writev pwrite pwrite64"
BUFFER_WRITERS = "memcpy memmove memset fread fread_unlocked fgets fgets_unlocked sprintf snprintf __sprintf_chk __snprintf_chk strcpy strcat stpcpy read"
PATH_ARGUMENT = {"open": "rdi", "open64": "rdi", "fopen": "rdi", "fopen64": "rdi", "freopen": "rdi", "opendir": "rdi", "scandir": "rdi", "openat": "rsi", "openat64": "rsi"}
GETC = "getc fgetc getc_unlocked fgetc_unlocked getchar getchar_unlocked getw"
PUTC = "putc fputc putc_unlocked fputc_unlocked putchar putchar_unlocked putw"
ARGUMENTS = ("rdi", "rsi", "rdx", "rcx", "r8", "r9")
CALLER_SAVED = frozenset("rax rcx rdx rsi rdi r8 r9 r10 r11".split())
O_WRONLY, O_RDWR, O_CREAT, O_TRUNC, O_APPEND = 1, 2, 0x40, 0x200, 0x400

# --- Fixed values: bounds --------------------------------------------------------------------------------------------
RECALL_HOPS, QUEUE_HOPS, WRAPPER_SIZE, REGISTRAR_SIZE, RESOLVER_SIZE = 3, 2, 60, 150, 80
CHANNEL_BACK, CHANNEL_DEPTH, SLOT_BACK, SLOT_CALL_BACK, OFFSET_BACK, OFFSET_DEPTH, TOUCH_AHEAD, CONSTANT_BACK, PATH_BACK = 39, 4, 249, 7, 29, 4, 25, 11, 39
UNREACHABLE, LITERAL_CAP, TOKEN_CAP, NEGATIVES_EACH = 99, 50, 200, 4
