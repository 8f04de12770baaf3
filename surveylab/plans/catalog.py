"""All registered queries (importing the modules fills the registry)."""

from surveylab.plans import catalog_core  # noqa: F401
from surveylab.plans import catalog_prep  # noqa: F401
from surveylab.plans import catalog_score  # noqa: F401
from surveylab.plans import catalog_ml  # noqa: F401
from surveylab.plans import catalog_io  # noqa: F401
from surveylab.plans.registry import REGISTRY  # noqa: F401
