"""sparkeda: automated exploratory data analysis as Spark DataFrame operators."""

from .session import checkpoint_dir, cut_lineage, get_spark  # noqa: F401
from .plans.facts import column_facts  # noqa: F401
from .plans.roles import (column_groups, column_roles, detect_candidate_targets,  # noqa: F401
                          detect_datetime_columns, detect_entity_id, detect_primary_keys,
                          detect_task_type, select_prediction_features, select_visual_columns,
                          skipped_columns)

__version__ = "0.1.0"
