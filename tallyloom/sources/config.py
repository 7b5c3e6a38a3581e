"""Settings in layers, defaults under a file under the environment under flags, and what is wrong with them. Driver-side
and plain Python: a run has one configuration."""

from __future__ import annotations

import copy
import json
import re
from collections.abc import Mapping

from ..operators.classify import ROLES

# The settings that hold where nothing else is said.
DEFAULTS = {
    "version": 1, "docs_dir": "docs/generated", "state_path": ".tallyloom/state.json", "report_path": "",
    "source": {
        "include": ["**/*"], "exclude": ["vendor/**", "node_modules/**", "dist/**", "build/**", "**/*.min.js", "**/*.min.css", "**/*.map", "**/*.lock"], "max_file_bytes": 1 << 20,
        "tests": {"include_as_context": True, "trigger_on_change": False}, "generated": {"include_as_context": False, "trigger_on_change": False}, "fixtures": {"include_as_context": False, "trigger_on_change": False}, "role_overrides": [],
    },
    "components": {"strategy": "inferred", "roots": [], "max_context_bytes": 120_000, "max_batch_bytes": 80_000, "max_supporting_bytes": 20_000, "max_manifest_bytes": 20_000, "max_diff_bytes": 40_000, "max_request_bytes": 500_000},
    "documentation": {"profile": "codebase-summary", "audience": "mixed", "mermaid": True, "generation_strategy": "dossier"},
    "llm": {"provider": "openai-compatible", "base_url": "", "model": "", "api_mode": "chat_completions", "temperature": 0, "max_output_tokens": 8_192, "max_response_bytes": 65_536, "structured_output_mode": "auto", "timeout": "60s", "retries": 2, "concurrency": 2, "fragment_call_limit_per_component": 80, "fragment_split_depth": 3},
    "publishing": {"provider": "worktree"},
    "runtime": {"base_revision": "", "head_revision": "", "credential_present": False},
}
#: The settings that the environment may give.
ENVIRONMENT = {"TALLYLOOM_DOCS_DIR": "docs_dir", "TALLYLOOM_STATE_PATH": "state_path", "TALLYLOOM_REPORT_PATH": "report_path", "TALLYLOOM_LLM_BASE_URL": "llm.base_url", "TALLYLOOM_LLM_MODEL": "llm.model", "TALLYLOOM_GENERATION_STRATEGY": "documentation.generation_strategy", "TALLYLOOM_PUBLISHER": "publishing.provider", "TALLYLOOM_BASE_REVISION": "runtime.base_revision", "TALLYLOOM_HEAD_REVISION": "runtime.head_revision"}
CREDENTIAL = "TALLYLOOM_LLM_API_KEY"
MOST_SPLIT_DEPTH = 8
_DURATION = re.compile(r"(?:\d+(?:\.\d+)?(?:h|ms|us|ns|m|s))+")


class ConfigError(ValueError):
    exit_code = 2


def _merge(base: dict, more: Mapping, at: str = "") -> None:
    for name, value in more.items():
        where = f"{at}{name}"
        if name == "include" and at in ("source.tests.", "source.generated.", "source.fixtures."):
            name = "include_as_context"  # the short name
        if name not in base:
            raise ConfigError(f"unknown setting {where}")
        if isinstance(base[name], dict):
            if not isinstance(value, Mapping):
                raise ConfigError(f"{where} must be a table")
            _merge(base[name], value, where + ".")
        elif type(base[name]) is not type(value) and not (isinstance(base[name], (int, float)) and isinstance(value, (int, float)) and not isinstance(value, bool)):
            raise ConfigError(f"{where} must be {type(base[name]).__name__}")
        else:
            base[name] = value


def _put(config: dict, path: str, value) -> None:
    *above, last = path.split(".")
    for part in above:
        config = config[part]
    config[last] = value


def parse(text: str) -> dict:
    """One document of JSON, or of YAML where that library is there."""
    try:
        import yaml
    except ImportError:
        yaml = None
    try:
        found = json.loads(text) if yaml is None else yaml.safe_load(text)
    except ValueError as e:
        raise ConfigError(f"the configuration can't be read: {e}") from e
    except Exception as e:  # the library's own errors are no ValueError
        raise ConfigError(f"the configuration can't be read: {e}") from e
    if found is not None and not isinstance(found, dict):
        raise ConfigError("the configuration must be a table")
    return found or {}


def load(text: str | None, environment: Mapping[str, str], flags: Mapping[str, object] | None = None) -> dict:
    """The settings of a run. `text` is the file's, or none; flags are given by their dotted names."""
    config = copy.deepcopy(DEFAULTS)
    _merge(config, parse(text) if text and text.strip() else {})
    for name, path in ENVIRONMENT.items():
        if name in environment:
            _put(config, path, environment[name].strip())
    config["runtime"]["credential_present"] = bool(environment.get(CREDENTIAL, "").strip())
    for path, value in (flags or {}).items():
        if value not in (None, ""):
            _put(config, path, value.strip() if isinstance(value, str) else value)
    if found := problems(config):
        raise ConfigError("; ".join(found))
    return config


def problems(c: dict) -> list[str]:
    """What is wrong with the settings, in order."""
    s, k, d, m = c["source"], c["components"], c["documentation"], c["llm"]
    limits = ["max_context_bytes", "max_batch_bytes", "max_supporting_bytes", "max_manifest_bytes", "max_diff_bytes", "max_request_bytes"]
    roots = [r.strip() for r in k["roots"]]
    timeout = m["timeout"] if isinstance(m["timeout"], str) else ""
    checks = [
        (c["version"] == 1, f"version: unsupported value {c['version']} (want 1)"),
        (c["docs_dir"].strip(), "docs_dir: must not be empty"),
        (c["state_path"].strip(), "state_path: must not be empty"),
        (s["include"], "source.include: must contain at least one pattern"),
        (s["max_file_bytes"] > 0, "source.max_file_bytes: must be greater than zero"),
        *[(supported_role(o.get("role")), f"source.role_overrides: unsupported role {o.get('role')!r}") for o in s["role_overrides"]],
        (k["strategy"] in ("inferred", "explicit"), 'components.strategy: must be "inferred" or "explicit"'),
        (k["strategy"] != "explicit" or roots, "components.roots: must not be empty for explicit strategy"),
        *[(k[n] > 0, f"components.{n}: must be greater than zero") for n in limits],
        (k["max_batch_bytes"] <= k["max_context_bytes"], "components.max_batch_bytes: must not exceed max_context_bytes"),
        *[(r, f"components.roots[{i}]: must not be empty") for i, r in enumerate(roots)],
        *[(r not in roots[:i], f"components.roots[{i}]: duplicate root {r!r}") for i, r in enumerate(roots)],
        (d["profile"] == "codebase-summary", f"documentation.profile: unsupported value {d['profile']!r}"),
        (d["audience"] in ("mixed", "human", "ai-assistant"), f"documentation.audience: unsupported value {d['audience']!r}"),
        (d["generation_strategy"] in ("auto", "dossier", "fragments"), 'documentation.generation_strategy: must be "auto", "dossier", or "fragments"'),
        (m["provider"] == "openai-compatible", f"llm.provider: unsupported value {m['provider']!r}"),
        (m["api_mode"] in ("chat_completions", "responses"), f"llm.api_mode: unsupported value {m['api_mode']!r}"),
        (0 <= m["temperature"] <= 2, "llm.temperature: must be between 0 and 2"),
        (m["max_output_tokens"] > 0, "llm.max_output_tokens: must be greater than zero"),
        (m["max_response_bytes"] > 0, "llm.max_response_bytes: must be greater than zero"),
        (m["structured_output_mode"] in ("auto", "json_schema", "prompt_json"), f"llm.structured_output_mode: unsupported value {m['structured_output_mode']!r}"),
        (_DURATION.fullmatch(timeout) and re.search("[1-9]", timeout), "llm.timeout: must be a positive duration"),
        (m["retries"] >= 0, "llm.retries: must not be negative"),
        (m["concurrency"] > 0, "llm.concurrency: must be greater than zero"),
        (m["fragment_call_limit_per_component"] > 0, "llm.fragment_call_limit_per_component: must be greater than zero"),
        (0 <= m["fragment_split_depth"] <= MOST_SPLIT_DEPTH, f"llm.fragment_split_depth: must be between 0 and {MOST_SPLIT_DEPTH}"),
        (c["publishing"]["provider"] in ("worktree", "pull-request"), 'publishing.provider: must be "worktree" or "pull-request"'),
    ]
    return [text for ok, text in checks if not ok]


def supported_role(role: str | None) -> bool:
    return role in ROLES


def options(command: str, output: str = "human", base: str = "", head: str = "", full: bool = False) -> dict:
    """A command's options, tidied: the output is human or json, a head needs a base, and a full run has no range."""
    output, base, head = output.strip() or "human", base.strip(), head.strip()
    if output not in ("human", "json"):
        raise ConfigError(f"unsupported output {output!r}")
    if head and not base:
        raise ConfigError("a head revision needs a base revision")
    if full and base:
        raise ConfigError("a full run takes no range of revisions")
    return {"command": command, "output": output, "base": base, "head": head, "full": full}


def policies(c: dict) -> dict[str, dict]:
    """The settings by what they are for: source, components, generation, publishing."""
    s, m = c["source"], c["llm"]
    generation = {n: m[n] for n in ("provider", "model", "api_mode", "temperature", "max_output_tokens", "max_response_bytes", "structured_output_mode", "fragment_call_limit_per_component", "fragment_split_depth")}
    return {"source": s | {"docs_dir": c["docs_dir"], "state_path": c["state_path"]}, "components": c["components"], "generation": c["documentation"] | generation | {"transport_retries": m["retries"]}, "publishing": c["publishing"]}
