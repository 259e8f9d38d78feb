"""A typed filter language for Spark: declare a scheme, bind it to a frame, filter and project with expressions."""

from .errors import ParseError
from .functions.base import Function, SimpleFunction
from .functions.builtin import standard as standard_functions
from .operators.engine import BoundFrame, Filter, bind
from .operators.lists import AlwaysList, ListDefinition, NeverList, RuleList, SetList, TableList
from .plans.lower import Lowering
from .plans.parser import Settings
from .scheme import Scheme, SchemeBuilder
from .types import BOOL, BYTES, INT, IP, Array, Map, Type

__version__ = "0.1.0"
__all__ = [
    "BOOL", "BYTES", "INT", "IP", "AlwaysList", "Array", "BoundFrame", "Filter", "Function", "ListDefinition", "Lowering", "Map", "NeverList", "ParseError",
    "RuleList", "Scheme", "SchemeBuilder", "Settings", "SetList", "SimpleFunction", "TableList", "Type", "bind", "standard_functions",
]
