"""One query an operator over the driver's tables, with its SQL."""
