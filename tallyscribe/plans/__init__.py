"""Named queries: importing this package fills the registry."""

import importlib

MODULES = ("q_series", "q_raters", "q_prep", "q_text", "q_models")

for _name in MODULES:
    importlib.import_module(f"tallyscribe.plans.{_name}")
