"""Language aliases, sink, sanitizer and format call names, and standard library prefixes."""

from __future__ import annotations

# Names by which a language may be given.
ALIASES = {
    "java": "java", "python": "python", "py": "python", "go": "go", "golang": "go", "php": "php", "javascript": "javascript", "js": "javascript",
    "typescript": "typescript", "ts": "typescript", "rust": "rust", "rs": "rust", "c": "c", "cpp": "c", "c++": "c",
}

# Call names of each kind of sink: exact, by suffix, by containment.
SINKS = {
    "go": {
        "is_process_exec": (("exec.Command", "exec.CommandContext"), (), ()),
        "is_db_query": ((), (".Query", ".Exec", ".QueryRow", ".Raw"), ()),
        "is_dynamic_eval": ((), (), ()),
        "is_deserialization": (("json.Unmarshal",), (), ("gob.",)),
        "is_file_io": (("os.Open", "os.Remove", "os.ReadFile"), (), ("ioutil.",)),
        "is_network_call": (("http.Get", "http.Post", "http.NewRequest"), (), ()),
        "is_output_render": (("template.HTML",), (), ()),
    },
    "python": {
        "is_process_exec": (("os.system",), (".run", ".Popen", ".call"), ("subprocess.",)),
        "is_db_query": ((), (".execute", ".raw"), ()),
        "is_dynamic_eval": (("eval", "exec"), (), ()),
        "is_deserialization": (("pickle.loads", "yaml.load"), (), ()),
        "is_file_io": (("open", "os.remove"), (), ("shutil.",)),
        "is_network_call": ((), (), ("requests.", "urllib.")),
        "is_output_render": (("render_template_string",), (), ()),
    },
    "javascript": {
        "is_process_exec": (("child_process.exec", "child_process.execSync", "child_process.spawn"), (), ()),
        "is_db_query": ((), (".query",), ()),
        "is_dynamic_eval": (("eval", "Function"), (), ()),
        "is_deserialization": (("JSON.parse",), (), ()),
        "is_file_io": ((), (), ("fs.",)),
        "is_network_call": (("fetch", "http.request"), (), ("axios.",)),
        "is_output_render": ((), (), ()),
    },
    "php": {
        "is_process_exec": (("exec", "shell_exec", "system", "passthru"), (), ()),
        "is_db_query": (("mysqli_query",), ("->query", "->exec"), ()),
        "is_dynamic_eval": (("eval", "create_function"), (), ()),
        "is_deserialization": (("unserialize",), (), ()),
        "is_file_io": (("fopen", "file_get_contents", "unlink"), (), ()),
        "is_network_call": (("curl_exec", "file_get_contents"), (), ()),
        "is_output_render": ((), (), ()),
    },
}

# Calls that clean their argument.
SANITIZERS = {
    "go": (),
    "python": ("shlex.quote", "bleach.clean"),
    "javascript": ("DOMPurify.sanitize", "encodeURIComponent"),
    "php": ("htmlspecialchars", "filter_var", "mysqli_real_escape_string"),
}

# Calls that format text, exact and by suffix.
FORMATS = {
    "go": (("fmt.Sprintf", "fmt.Sprint", "fmt.Sprintln", "fmt.Errorf"), ()),
    "python": ((), (".format",)),
    "javascript": ((), ()),
    "php": (("sprintf", "vsprintf"), ()),
}

# First parts of standard library names.
STDLIB = {
    "go": (
        "fmt", "os", "io", "ioutil", "net", "http", "strings", "strconv", "time", "context", "errors", "sync", "bytes", "encoding", "json", "sql", "exec", "regexp", "path", "filepath",
        "log", "reflect", "sort", "gob",
    ),
    "python": (
        "os", "sys", "re", "json", "subprocess", "io", "time", "itertools", "collections", "typing", "pathlib", "shutil", "urllib", "http", "socket", "pickle", "logging", "functools",
        "hashlib", "shlex", "glob",
    ),
    "javascript": ("JSON", "Math", "console", "fs", "path", "http", "https", "crypto", "util"),
    "php": (),
}
