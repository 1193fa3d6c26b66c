"""DataFrame -> DataFrame operators. Every function is lazy unless its docstring says otherwise."""
