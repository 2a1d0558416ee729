"""The driver's tables as inputs: derivations, registered queries and their check SQL."""
