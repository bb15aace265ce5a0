"""Panel analytics on Spark: entity x period tables from raw files to models."""

from panelweave.config import PanelConfig

__all__ = ["PanelConfig"]
