"""trustframe: how far can a labelled feature table be trusted for classification?

Every public function takes DataFrames and returns DataFrames.
"""

from trustframe.config import ReportConfig

__all__ = ["ReportConfig"]
