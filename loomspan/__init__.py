"""loomspan: preparing and evaluating aligned and annotated text on Spark."""
