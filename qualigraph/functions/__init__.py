"""Column functions: everything here compiles to built-in expressions unless it says otherwise."""
