from nearkin.cli import main

main()
