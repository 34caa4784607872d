"""Sessions, stages, projections and registered queries."""
