"""Reading PHP source: lexer, parser, facts."""
