from gridloom.cli import main

main()
