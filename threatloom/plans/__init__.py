"""Jobs that chain operators, and the registered queries."""

AS_OF = "2024-02-01 00:00:00"
