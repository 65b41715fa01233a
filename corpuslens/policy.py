"""Scan policy: switches and the fixed word lists that decide a file's class. Size never decides, it is only named."""

from __future__ import annotations

from dataclasses import dataclass

POLICY_VERSION = 1


@dataclass(frozen=True)
class Policy:
    large_file_bytes: int = 1_048_576
    large_data_file_bytes: int = 65_536
    include_hidden: bool = False
    follow_symlinks: bool = False
    exclude_lockfiles: bool = True
    exclude_generated: bool = True
    hash_contents: bool = True


@dataclass(frozen=True)
class BundleOptions:
    headers: bool = True
    line_numbers: bool = False
    code_fences: bool = False
    file_size_annotations: bool = False
    include_tree: bool = True
    include_front_matter: bool = False
    normalize_line_endings: bool = True
    max_file_bytes: int | None = None
    include_project_map: bool = False


# These lists must be exactly so for the right classification.

SENSITIVE_GLOBS = [
    "**/.env", "**/.env.*", "**/.npmrc", "**/.pypirc", "**/.netrc", "**/_netrc",
    "**/.git-credentials", "**/.aws/credentials", "**/.aws/config", "**/.ssh/**",
    "**/.gnupg/**", "**/id_rsa", "**/id_dsa", "**/id_ecdsa", "**/id_ed25519", "**/*.pem",
    "**/*.key", "**/*.p12", "**/*.pfx", "**/*.keystore", "**/*.jks", "**/secrets.json",
    "**/secrets.yaml", "**/secrets.yml", "**/credentials.json", "**/service-account*.json",
    "**/.terraform/**", "**/*.tfstate", "**/*.tfstate.backup", "**/.kube/config",
    "**/.docker/config.json",
]
SENSITIVE_ALLOW_GLOBS = ["**/.env.example", "**/.env.*.example"]

SKIPPED_DIRS = [
    ".git", ".hg", ".svn", ".DS_Store", "node_modules", "target", "dist", "build", "out",
    ".next", ".nuxt", ".svelte-kit", ".turbo", ".venv", "venv", "__pycache__", ".mypy_cache",
    ".pytest_cache", ".ruff_cache", ".gradle", ".idea", ".vs", "vendor", "Pods", "DerivedData",
]

LOCKFILE_NAMES = [
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb", "Cargo.lock",
    "poetry.lock", "Pipfile.lock", "uv.lock", "composer.lock", "Gemfile.lock", "go.sum",
    "gradle.lockfile", "packages.lock.json",
]

# Fixed values.
BINARY_EXTENSIONS = [
    "png", "jpg", "jpeg", "gif", "bmp", "ico", "icns", "tiff", "webp", "avif", "heic", "svgz",
    "mp3", "wav", "flac", "ogg", "m4a", "aac", "mp4", "mov", "avi", "mkv", "webm", "wmv",
    "zip", "gz", "tgz", "bz2", "xz", "zst", "7z", "rar", "tar", "jar", "war", "ear",
    "exe", "dll", "so", "dylib", "a", "lib", "o", "obj", "bin", "dat", "class", "pyc", "pyo", "pdb", "wasm",
    "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "odt", "ods", "sqlite", "sqlite3", "db", "mdb",
    "ttf", "otf", "woff", "woff2", "eot", "psd", "ai", "sketch", "fig", "blend",
    "gguf", "safetensors", "onnx", "pt", "pth", "ckpt", "h5", "npy", "npz", "parquet", "arrow", "dmg", "iso", "img",
]

# Fixed values.
DATA_EXTENSIONS = [
    "json", "yaml", "yml", "xml", "csv", "tsv", "ndjson", "jsonl", "plist", "svg", "geojson", "graphql",
    "sql", "po", "pot", "properties",
]

GENERATED_DIR_MARKERS = [
    "/node_modules/", "/dist/", "/build/", "/target/", "/coverage/", "/.next/",
    "/__generated__/", "/generated/", "/gen/", "/.gen/", "/gen_/", "/obj/", "/bin/debug/",
    "/bin/release/", "/.dart_tool/", "/.terraform/", "/vendor/", "/third_party/",
]
GENERATED_SUFFIXES = [
    ".min.js", ".min.css", ".min.mjs", ".map", ".bundle.js", ".chunk.js", "-lock.json",
    ".pb.go", ".pb.cc", ".pb.h", "_pb2.py", ".g.dart", ".freezed.dart", ".generated.ts",
]

TEST_DIR_MARKERS = [
    "/test/", "/tests/", "/__tests__/", "/spec/", "/specs/", "/e2e/", "/__mocks__/",
    "/testdata/", "/fixtures/", "/__snapshots__/", "/cypress/", "/playwright/",
]
TEST_NAME_MARKERS = [".test.", ".spec.", "_test.", "_spec.", ".snap", "conftest.py"]

DOCS_DIR_MARKERS = [
    "/docs/", "/doc/", "/examples/", "/example/", "/samples/", "/benches/", "/benchmark/",
    "/benchmarks/", "/.github/", "/website/",
]

CLASS_LABELS = {
    "source_text": "text",
    "binary": "binary",
    "generated": "generated",
    "lockfile": "lockfile",
    "credential_sensitive": "credential-sensitive",
    "hidden_metadata": "hidden/metadata",
    "symlink": "symlink",
    "unsupported_encoding": "unsupported encoding",
    "unreadable": "unreadable",
}

# Why a file of a class is left out, in this project's own words.
EXCLUSION_REASONS = {
    "credential_sensitive": "Credential path: include it only after confirming this one file.",
    "symlink": "Symbolic link: pick the file it points to.",
    "binary_extension": "The file name says binary.",
    "binary_content": "The content looks binary.",
    "unsupported_encoding": "The bytes are not UTF-8.",
    "lockfile": "Lockfile of a package manager.",
    "generated": "Generated, vendored or minified.",
    "hidden_metadata": "Hidden file or editor data.",
}

OVERRIDE_CLASSES = [
    "credential_sensitive", "binary", "unsupported_encoding", "unreadable",
]

# Ignore sources, weakest first; the rank is the position.
IGNORE_SOURCES = [
    "git_global", "git_info_exclude", "git_ignore", "ai_ignore", "policy", "user_override",
]

# Build, dependency, CI, deployment and permission files whose change matters beyond themselves.
MANIFEST_NAMES = [
    "cargo.toml", "package.json", "pyproject.toml", "setup.py", "setup.cfg", "pipfile",
    "go.mod", "go.sum", "gemfile", "composer.json", "pom.xml", "build.gradle",
    "build.gradle.kts", "settings.gradle", "settings.gradle.kts", "package.swift", "podfile",
    "build.rs", "makefile", ".npmrc",
]
CI_NAMES = [".gitlab-ci.yml", "azure-pipelines.yml", "jenkinsfile", "bitbucket-pipelines.yml"]
CI_DIRS = [".github", ".circleci", ".buildkite", ".husky"]
INFRA_DIRS = ["terraform", "k8s", "kubernetes", "helm", "deploy", "infra"]
PERMISSION_NAMES = [".gitignore", ".aiignore", "tauri.conf.json"]

INJECTION_PHRASES = [
    "ignore prior instructions",
    "ignore all previous instructions",
    "disregard previous directives",
    "system prompt override",
    "you are now in developer mode",
    "bypass security restrictions",
    "sudo rm -rf",
    "write to /etc/",
    "exfiltrate credentials",
    "curl -x post",
    "send api key",
]
