"""All registered queries."""

from posewatch.plans import (  # noqa: F401
    content_queries,
    frame_queries,
    input_queries,
    sample_queries,
    state_queries,
    stream_queries,
)
from posewatch.plans.registry import CHECKS, QUERIES  # noqa: F401
