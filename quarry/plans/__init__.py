"""Front-end: lexer, syntax tree, parser, printer, planner."""
