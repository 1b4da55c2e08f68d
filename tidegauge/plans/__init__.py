"""The dialect and the registered queries."""
