"""Rule tables and user overrides.

Rules live in small Python tables on the driver and become one DataFrame keyed by
extension, so that classification needs a single lookup join.
"""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# ---------------------------------------------------------------------------------------
# They decide which category, risk and alert a file gets.
# ---------------------------------------------------------------------------------------

CATEGORIES = [
    "data", "model", "config", "vector", "checkpoint", "source", "document", "multimedia",
    "skill", "agent", "secret",
]

EXTENSIONS_BY_CATEGORIES = {
    "data": ".jsonl .csv .tsv .parquet .arrow .feather .hdf5 .h5 .tfrecord .npy .npz .avro .orc"
    " .petastorm .nc .netcdf .zarr .loom .anndata .beton .mindrecord .recordio .idx .shard"
    " .tar.gz .wds",
    "model": ".onnx .pt .pth .safetensors .gguf .ggml .tflite .mlmodel .mar .pte .engine .plan"
    " .torchscript .savedmodel .h5model .keras .paddle .pdparams .pdmodel .mnn .ncnn .xmodel"
    " .om .air .mindir .ort .mlpackage",
    "model,data": ".pkl .pickle .joblib",
    "model,config": ".pb .bento .pmml",
    "model,checkpoint": ".ckpt",
    "config,source": ".ipynb",
    "vector": ".faiss .annoy .index .lancedb .hnsw .usearch .voy .ivfpq .scann .hnswlib .nmslib"
    " .milvus",
    "source": ".py .js .ts .jsx .tsx .java .cpp .c .h .go .rs .rb .r .jl .scala .kt .swift .sh"
    " .bash .lua",
    "document": ".md .markdown .rst .tex .adoc .log .pdf .docx .doc .pptx .ppt .odt .rtf .epub"
    " .html .htm .css",
    "document,data": ".xlsx .xls .ann .conll .brat .bio",
    "document,config": ".xml",
    "document,source": ".rmd .qmd",
    "multimedia": ".png .jpg .jpeg .gif .bmp .tiff .tif .webp .ico .heic .heif .avif .jxl .svg"
    " .eps .ai .psd .xcf .sketch .fig .exr .hdr .raw .wav .mp3 .flac .ogg .m4a .aac .opus .wma"
    " .aiff .aif .mid .midi .mp4 .avi .mov .mkv .webm .wmv .flv .m4v .mpg .mpeg .mts .obj .stl"
    " .glb .gltf .fbx .usdz .ass .sub",
    "multimedia,data": ".dcm .dicom .nii .nii.gz .ply .pcd .srt .vtt",
    "skill": ".skill .tool",
    "agent,config": ".prompt .systemprompt .goal .persona .instruction",
    "secret": ".pem .key .p12 .pfx .keystore .jks .credentials .secret .token .htpasswd .pgpass"
    " .netrc",
}

AMBIGUOUS = [".yaml", ".yml", ".bin", ".db", ".sqlite", ".sqlite3", ".json"]
MEDIUM_CONFIDENCE = [
    ".yaml", ".yml", ".bin", ".db", ".sqlite", ".sqlite3", ".pkl", ".pickle", ".index",
]

SECRET_FILE_REASON = "Secret/credential file — contains sensitive data"
EMBEDDED_SECRET_REASON = "Possible embedded secret/credential detected"
BINARY_REASON = "Unknown binary format may contain unsafe serialized data"
RISKS = {
    ".pkl": ("danger", "Pickle deserialization can execute arbitrary code"),
    ".pickle": ("danger", "Pickle deserialization can execute arbitrary code"),
    ".joblib": ("warning", "Joblib uses pickle internally — similar risk"),
    ".mar": ("warning", "Model archives may contain pickled components"),
    ".bin": ("warning", "Binary model file — may use pickle serialization"),
    ".ggml": ("warning", "Legacy format — consider converting to GGUF"),
    **{ext: ("danger", SECRET_FILE_REASON) for ext in EXTENSIONS_BY_CATEGORIES["secret"].split()},
}
DEFAULT_RISK_REASON = "Custom risk rule"

AI_KEYWORDS = [
    "model", "training", "epochs", "batch_size", "learning_rate", "lr", "optimizer", "loss",
    "dataset", "tokenizer", "transformer", "attention", "embedding", "hidden_size",
    "num_layers", "num_heads", "dropout", "weight_decay", "warmup", "scheduler", "checkpoint",
    "pretrained", "fine_tune", "finetune", "backbone", "encoder", "decoder", "vocab_size",
    "max_length", "max_seq_length", "gradient", "wandb", "tensorboard", "huggingface", "torch",
    "tensorflow", "diffusion", "lora", "qlora", "peft", "rlhf", "sft", "inference",
    "quantization", "pruning", "distillation", "pipeline", "feature_extractor",
    "image_processor", "prompt", "completion", "chat_template", "system_prompt",
]
SKILL_KEYWORDS = [
    "tool_use", "function_call", "actions", "plugin", "skill", "capability", "langchain",
    "autogen", "crewai", "openai_function", "agent", "tool_choice", "langgraph", "dspy",
    "pydantic_ai", "smolagents",
]
AGENT_KEYWORDS = [
    "system_prompt", "you are", "your role", "assistant", "persona", "goal", "objective",
    "instruction", "behave as", "act as", "respond as", "rules:", "guidelines:",
    "constraints:", "backstory", "expected_output", "crew", "crewai", "langchain",
    "langgraph", "autogen", "dspy", "agent_executor", "tool_node", "state_graph",
]
VECTOR_DB_WORDS = [
    "embedding", "vector", "chroma", "langchain", "collection", "faiss", "annoy", "lance",
]
KEYWORD_THRESHOLD = 2

SKILL_NAME = r"(?i)(agent|plugin|tool_def|skill)"
AGENT_NAME = (
    r"(?i)(system.?prompt|agent.?config|goal|persona|instruction|rules|prompt.?template"
    r"|crew.?config|task.?config|agent.?def|workflow.?def|chain.?config)"
)
AGENT_STEMS = [
    "system_prompt", "systemprompt", "system-prompt", "agent_config", "agentconfig",
    "agent-config", "goals", "persona", "instructions", "rules", "agents", "tasks", "crew",
]
AGENT_STEMS_NEEDING_EXTENSION = ["goals", "rules", "agents", "tasks", "crew"]
AGENT_EXTENSIONS = [".yaml", ".yml", ".json", ".md", ".txt"]
AGENT_EXACT_NAMES = [".cursorrules", ".claude", "AGENTS.md", "OAI_CONFIG_LIST", "MLmodel"]
SKILL_EXACT_NAME = "SKILL.md"
CHECKPOINT_WORDS = "checkpoint|model|epoch|step|ckpt|run|experiment"
CHECKPOINT_ENDINGS = r"\d+|best|latest|final|last"
ENV_NAME = r"(?i)^\.env(\..+)?$"
SECRET_NAME = (
    r"(?i)^(credentials\.(json|yaml|yml)|secrets?\.(json|yaml|yml|toml)|service[-_]account\.json"
    r"|id_(rsa|ed25519|ecdsa)(\.pub)?|\.npmrc|\.pypirc|\.htpasswd|\.pgpass|\.netrc)$"
)
SECRET_CONTENT = [
    ("api_key", r"(?i)(api[_-]?key|apikey)\s*[:=]\s*['\"]?\w{16,}"),
    ("password", r"(?i)(secret|password|passwd|pwd)\s*[:=]\s*['\"]?\S{8,}"),
    ("access_token", r"(?i)(access[_-]?token|auth[_-]?token|bearer)\s*[:=]\s*['\"]?\S{16,}"),
    ("aws_access_key", r"AKIA[0-9A-Z]{16}"),
    ("github_token", r"(ghp_|gho_|ghs_|ghr_)[a-zA-Z0-9]{36}"),
    ("sk_key", r"sk-[a-zA-Z0-9]{20,}"),
    ("private_key", r"-----BEGIN\s+(RSA\s+)?PRIVATE\s+KEY-----"),
    ("connection_string", r"(?i)(mongodb\+srv|postgres|mysql)://[^@\s]+@"),
]
# Words one of which, ignoring case, is part of every match of a rule.
SECRET_ANCHORS = {
    "api_key": ["api"],
    "password": ["secret", "password", "passwd", "pwd"],
    "access_token": ["access", "auth", "bearer"],
    "aws_access_key": ["akia"],
    "github_token": ["ghp_", "gho_", "ghs_", "ghr_"],
    "sk_key": ["sk-"],
    "private_key": ["-----begin"],
    "connection_string": ["mongodb+srv", "postgres", "mysql"],
}
NOT_SCANNED_FOR_SECRETS = ["model", "multimedia", "checkpoint", "vector"]

MODEL_FOLDER_FILES = [
    "config.json", "tokenizer.json", "tokenizer_config.json", "generation_config.json",
]
LARGE_BINARY_BYTES = 100 * 1024 * 1024
BINARY_MAGIC = {"GGUF": 4, "ggml": 4, "PK": 2}
SQLITE_MAGIC = "SQLite format 3"

SKIPPED_FOLDERS = [
    "__pycache__", ".git", ".svn", ".hg", "node_modules", ".tox", ".mypy_cache",
    ".pytest_cache", ".ruff_cache", "venv", ".venv", "env", ".env",
]

# How much of a file the content rules look at when files are read from disk.
KEYWORD_CHARS = 2048
YAML_CHARS = 4096
SECRET_CHARS = 4096
DATABASE_BYTES = 65536

# ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Window:
    """How many leading characters or bytes the content rules see; None means all."""

    keyword_chars: int | None = None
    yaml_chars: int | None = None
    secret_chars: int | None = None
    database_bytes: int | None = None


WHOLE = Window()
FILE_HEADS = Window(KEYWORD_CHARS, YAML_CHARS, SECRET_CHARS, DATABASE_BYTES)

EXTENSION_RULES = T.StructType(
    [
        T.StructField("rule_extension", T.StringType(), False),
        T.StructField("rule_categories", T.ArrayType(T.StringType(), False)),
        T.StructField("rule_ambiguous", T.BooleanType(), False),
        T.StructField("rule_confidence", T.StringType(), False),
        T.StructField("rule_risk_level", T.StringType()),
        T.StructField("rule_risk_reason", T.StringType()),
    ]
)


def _default_extensions() -> dict[str, list[str]]:
    return {
        ext: names.split(",")
        for names, extensions in EXTENSIONS_BY_CATEGORIES.items()
        for ext in extensions.split()
    }


def _dotted(ext: str) -> str:
    return (ext if ext.startswith(".") else f".{ext}").lower()


@dataclass(frozen=True)
class Rules:
    """Extension, risk and secret rules of one run."""

    extensions: dict[str, list[str]] = field(default_factory=_default_extensions)
    risks: dict[str, tuple[str, str]] = field(default_factory=lambda: dict(RISKS))
    ambiguous: frozenset[str] = frozenset(AMBIGUOUS)
    secrets: tuple[tuple[str, str], ...] = tuple(SECRET_CONTENT)
    window: Window = WHOLE

    def with_window(self, window: Window) -> Rules:
        return replace(self, window=window)

    def with_secrets(self, *extra: tuple[str, str]) -> Rules:
        """Add ``(rule_id, regex)`` pairs to the embedded-secret rules."""
        return replace(self, secrets=self.secrets + extra)

    def with_overrides(self, config: dict) -> Rules:
        """Merge a user config: ``extensions``, ``risks``, ``ambiguous``, ``ignore_extensions``.

        Entries with an unknown category or risk level are left out with a warning; ignoring
        comes last and wins.
        """
        extensions, risks = dict(self.extensions), dict(self.risks)
        ambiguous = set(self.ambiguous)
        for ext, names in config.get("extensions", {}).items():
            wanted = [n.lower() for n in (names if isinstance(names, list) else [names])]
            unknown = [n for n in wanted if n not in CATEGORIES]
            if unknown:
                warnings.warn(f"unknown category {unknown[0]!r} for {_dotted(ext)}", stacklevel=2)
                continue
            extensions[_dotted(ext)] = wanted
        for ext, risk in config.get("risks", {}).items():
            spec = risk if isinstance(risk, dict) else {"level": risk}
            level = spec.get("level", "warning")
            if level not in ("danger", "warning"):
                warnings.warn(f"invalid risk level {level!r} for {_dotted(ext)}", stacklevel=2)
                continue
            risks[_dotted(ext)] = (level, spec.get("reason", DEFAULT_RISK_REASON))
        ambiguous |= {_dotted(ext) for ext in config.get("ambiguous", [])}
        for ext in map(_dotted, config.get("ignore_extensions", [])):
            extensions.pop(ext, None)
            risks.pop(ext, None)
            ambiguous.discard(ext)
        return replace(
            self, extensions=extensions, risks=risks, ambiguous=frozenset(ambiguous)
        )

    @classmethod
    def from_json(cls, path: str | None) -> Rules:
        """Default rules merged with a JSON config file; a bad file only warns."""
        if path is None:
            return cls()
        try:
            with open(path, encoding="utf-8") as fh:
                config = json.load(fh)
        except (OSError, json.JSONDecodeError) as err:
            warnings.warn(f"failed to load config {path}: {err}", stacklevel=2)
            return cls()
        return cls().with_overrides(config)

    def extension_rules(self, spark: SparkSession) -> DataFrame:
        """One row per extension with everything a file's extension decides."""
        rows = []
        for ext in sorted(set(self.extensions) | set(self.risks) | self.ambiguous):
            level, reason = self.risks.get(ext, (None, None))
            confidence = "medium" if ext in MEDIUM_CONFIDENCE else "high"
            rows.append(
                (ext, self.extensions.get(ext), ext in self.ambiguous, confidence, level, reason)
            )
        return local_table(spark, rows, EXTENSION_RULES)


def local_table(spark: SparkSession, rows: list[tuple], schema: T.StructType | str) -> DataFrame:
    """A small driver-side table, handed over as Arrow data, so that reading it needs no job."""
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    columns = list(zip(*rows))
    arrow = to_arrow_schema(struct)
    arrays = [pa.array(values, type=field.type) for values, field in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=struct.fieldNames()), struct)
