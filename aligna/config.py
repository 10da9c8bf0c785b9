"""Settings: defaults, then a YAML file, then the environment, then arguments."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace

from aligna import constants as K


@dataclass(frozen=True)
class Config:
    data_dir: str = "data"
    translator: str = "mock"
    api_key: str = ""
    base_url: str = ""
    model: str = "default"
    temperature: float = 0.3
    top_p: float = 0.9
    timeout: int = 120
    qa_enabled: bool = True
    tm_similarity_threshold: float = K.SIMILARITY

    @property
    def tm_dir(self) -> str:
        return f"{self.data_dir}/tm"

    @property
    def output_dir(self) -> str:
        return f"{self.data_dir}/output"


def load(path: str | None = None, env=os.environ, **arguments) -> Config:
    """Unknown keys are dropped. The environment wins over the file for translator and threshold, the file over the
    environment for the key; a threshold that is no number is ignored."""
    known = {f.name for f in fields(Config)}
    values = {}
    if path:
        import yaml

        with open(path, encoding="utf-8") as f:
            values = {k: v for k, v in (yaml.safe_load(f) or {}).items() if k in known}
    if env.get("ALIGNA_TRANSLATOR"):
        values["translator"] = env["ALIGNA_TRANSLATOR"]
    try:
        values["tm_similarity_threshold"] = float(env["ALIGNA_TM_THRESHOLD"])
    except (KeyError, ValueError):
        pass
    if not values.get("api_key"):
        values["api_key"] = env.get("ALIGNA_API_KEY", "")
    return replace(Config(**values), **{k: v for k, v in arguments.items() if v is not None and k in known})
